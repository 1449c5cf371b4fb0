"""Queries over reports, baselines, outcomes, lags, models and streams' batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..operators import hash_tree as ht
from ..operators import temporal as t
from ..sources import tables as s
from ..sources.scratch import scratch_dir
from ..sources.versioned import VersionedTable
from ..streaming import monitors as m
from .registry import query
from .temporal import EVENTS_SQL, assumption_events

CLASSES = ["CUT", "HOLD", "HIKE"]
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 21)]
_PERSIST = f"""WITH {s.OUTCOMES_SQL}, p AS (SELECT o_custkey AS desk, meeting, action AS actual, coalesce(lag(action) OVER (PARTITION BY o_custkey ORDER BY meeting), 'HOLD') AS predicted FROM outc JOIN orders ON meeting = o_orderkey)"""
_HISTORY = f"""WITH {s.VOTES_SQL}, h AS (SELECT meeting, participant, dissent, avg(dissent::INT) OVER (PARTITION BY participant ORDER BY meeting ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_rate FROM mv)"""
_REPORT = """SELECT *, coalesce((tp + fn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0) AS base_rate, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity, (coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2 AS balanced, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM"""
_TRACE = f"""{_HISTORY}, g AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]::DOUBLE[]) AS threshold),
k AS (SELECT threshold, count(*) FILTER (dissent AND said) AS tp, count(*) FILTER (NOT dissent AND said) AS fp, count(*) FILTER (dissent AND NOT said) AS fn, count(*) FILTER (NOT dissent AND NOT said) AS tn
FROM (SELECT threshold, dissent, coalesce(prior_rate >= threshold, false) AS said FROM h, g) GROUP BY 1), tr AS ({_REPORT} k)"""


def _persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    desks = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting"), F.col("o_custkey").alias("desk"))
    rows = t.persistence(s.outcomes(spark, sf_dir).join(desks, "meeting"), "desk")
    return rows.select("desk", "meeting", F.col("action").alias("actual"), F.coalesce("persisted", F.lit("HOLD")).alias("predicted"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.prior_history(s.member_votes(spark, sf_dir))


@query("a10_m06_class_report", f"""{_PERSIST}, k AS (SELECT c AS class, count(*) FILTER (actual = c) AS support, count(*) FILTER (predicted = c) AS said, count(*) FILTER (actual = c AND predicted = c) AS hit FROM p, (VALUES ('CUT'), ('HOLD'), ('HIKE')) v(c) GROUP BY 1)
SELECT class, support, coalesce(hit::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * hit / nullif(said + support, 0), 0) AS f1 FROM k""")
def a10_m06_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.class_report(_persistence(spark, sf_dir), CLASSES)


@query("a11_binary_report", f"{_HISTORY}, k AS (SELECT count(*) FILTER (dissent AND said) AS tp, count(*) FILTER (NOT dissent AND said) AS fp, count(*) FILTER (dissent AND NOT said) AS fn, count(*) FILTER (NOT dissent AND NOT said) AS tn FROM (SELECT dissent, coalesce(prior_rate >= 0.3, false) AS said FROM h)) {_REPORT} k")
def a11_binary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.coalesce(F.col("prior_rate") >= 0.3, F.lit(False))
    return e.binary_report(_history(spark, sf_dir).agg(*e.binary_counts(F.col("dissent"), said)))


@query("m07_threshold_trace", f"{_TRACE} SELECT * FROM tr")
def m07_threshold_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.threshold_trace(_history(spark, sf_dir), THRESHOLDS)


@query("m07_o07_best_threshold", f"{_TRACE} SELECT threshold, f1 FROM tr ORDER BY f1 DESC, balanced DESC, precision DESC, threshold DESC LIMIT 1")
def m07_o07_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.best_threshold(m07_threshold_trace(spark, sf_dir))


_SPLIT = "1997-01-01"


def _dated(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return rows.join(s.outcomes(spark, sf_dir).select("meeting", "decided_on"), "meeting")


def _in_test() -> Column:
    return F.col("decided_on") >= F.lit(_SPLIT).cast("date")


@query("m07_vote_baselines", f"""WITH {s.VOTES_SQL}, {s.OUTCOMES_SQL}, h AS (SELECT meeting, dissent, avg(dissent::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rate, coalesce(lag(dissent) OVER w, false) AS prev FROM mv WINDOW w AS (PARTITION BY participant ORDER BY meeting)),
d AS (SELECT h.*, decided_on >= DATE '{_SPLIT}' AS test FROM h JOIN outc USING (meeting)), g AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]::DOUBLE[]) AS threshold),
k AS (SELECT threshold, count(*) FILTER (dissent AND said) AS tp, count(*) FILTER (NOT dissent AND said) AS fp, count(*) FILTER (dissent AND NOT said) AS fn, count(*) FILTER (NOT dissent AND NOT said) AS tn FROM (SELECT threshold, dissent, coalesce(rate >= threshold, false) AS said FROM d, g WHERE NOT test) GROUP BY 1),
b AS (SELECT threshold AS t FROM ({_REPORT} k) ORDER BY f1 DESC, balanced DESC, precision DESC, threshold DESC LIMIT 1),
u AS (SELECT 'all_for' AS baseline, 0 AS place, dissent, false AS said FROM d WHERE test UNION ALL SELECT 'previous_vote', 1, dissent, prev FROM d WHERE test UNION ALL SELECT 'prior_dissent_rate', 2, dissent, coalesce(rate >= t, false) FROM d, b WHERE test),
c AS (SELECT baseline, place, count(*) FILTER (dissent AND said) AS tp, count(*) FILTER (NOT dissent AND said) AS fp, count(*) FILTER (dissent AND NOT said) AS fn, count(*) FILTER (NOT dissent AND NOT said) AS tn FROM u GROUP BY 1, 2)
SELECT z.* EXCLUDE (place), CASE WHEN place = 2 THEN t END AS threshold, row_number() OVER (ORDER BY f1 DESC, balanced DESC, precision DESC, place) = 1 AS is_reference FROM ({_REPORT} c) z, b""")
def m07_vote_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines on votes from a date on, with the threshold of the votes before it."""
    return e.vote_baselines(_dated(spark, sf_dir, _history(spark, sf_dir)), _in_test(), THRESHOLDS)


@query("m06_frozen_split", f"""WITH {s.OUTCOMES_SQL}, p AS (SELECT action, decided_on >= DATE '{_SPLIT}' AS test, lag(action) OVER (PARTITION BY o_custkey ORDER BY meeting) AS persisted FROM outc JOIN orders ON meeting = o_orderkey),
m AS (SELECT action AS a FROM p WHERE NOT test GROUP BY 1 ORDER BY count(*) DESC, list_position(['CUT', 'HOLD', 'HIKE'], action) LIMIT 1),
u AS (SELECT 'majority' AS predictor, action, a AS said FROM p, m WHERE test UNION ALL SELECT 'persistence', action, persisted FROM p WHERE test),
k AS (SELECT predictor, c AS class, count(*) FILTER (action = c) AS support, count(*) FILTER (said = c) AS n, count(*) FILTER (action = c AND said = c) AS hit FROM u, (VALUES ('CUT'), ('HOLD'), ('HIKE')) v(c) GROUP BY 1, 2)
SELECT predictor, class, support, coalesce(hit::DOUBLE / nullif(n, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * hit / nullif(n + support, 0), 0) AS f1 FROM k""")
def m06_frozen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    desks = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting"), F.col("o_custkey").alias("desk"))
    cases = t.persistence(s.outcomes(spark, sf_dir).join(desks, "meeting"), "desk").withColumnRenamed("action", "actual")
    return e.frozen_split_report(cases, _in_test(), CLASSES)


@query("m06_split_hash", f"""WITH {s.OUTCOMES_SQL}, e AS (SELECT decided_on >= DATE '{_SPLIT}' AS test, sha256(length(meeting::VARCHAR) || ':' || meeting || '|' || length(action) || ':' || action) AS f, count(*) AS n FROM outc GROUP BY ALL),
b AS (SELECT test, f[1:4] AS p, sum(n) AS n, sha256(string_agg(f || '*' || n, '|' ORDER BY f)) AS h FROM e GROUP BY 1, 2), m AS (SELECT test, p[1:2] AS p, sum(n) AS n, sha256(string_agg(p || ':' || h, '|' ORDER BY p)) AS h FROM b GROUP BY 1, 2)
SELECT test, sum(n)::BIGINT AS n_rows, sha256(string_agg(p || ':' || h, '|' ORDER BY p)) AS root FROM m GROUP BY 1""")
def m06_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of each side of the split: an evaluation names the cases that it saw."""
    return ht.roots(s.outcomes(spark, sf_dir).withColumn("test", _in_test()), ["meeting", "action"], "test", levels=2)


@query("a12_m08_micro_average", f"{_HISTORY}, k AS (SELECT meeting % 5 AS variant, count(*) FILTER (dissent AND said) AS tp, count(*) FILTER (NOT dissent AND said) AS fp, count(*) FILTER (dissent AND NOT said) AS fn, count(*) FILTER (NOT dissent AND NOT said) AS tn FROM (SELECT meeting, dissent, coalesce(prior_rate >= 0.3, false) AS said FROM h) GROUP BY 1) {_REPORT} k")
def a12_m08_micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.coalesce(F.col("prior_rate") >= 0.3, F.lit(False))
    cases = _history(spark, sf_dir).groupBy("meeting").agg(*e.binary_counts(F.col("dissent"), said))
    return e.binary_report(cases.groupBy(F.pmod("meeting", F.lit(5)).alias("variant")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]))


@query("a13_usage_totals", "SELECT l_suppkey, sum(l_quantity)::BIGINT AS tokens, count(*) FILTER (l_linenumber > 1) AS repairs FROM lineitem GROUP BY 1")
def a13_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = s.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", F.col("l_linenumber").alias("attempt"), F.col("l_quantity").alias("tokens"))).alias("usage"))
    rows = nested.select(F.explode("usage").alias("u"))
    return rows.groupBy(F.col("u.l_suppkey").alias("l_suppkey")).agg(F.sum("u.tokens").cast("long").alias("tokens"), F.count_if(F.col("u.attempt") > 1).alias("repairs"))


@query("m11_ensemble", """WITH p AS (SELECT l_orderkey AS "case", (['CUT', 'HOLD', 'HIKE'])[(l_suppkey % 3) + 1] AS action FROM lineitem), c AS (SELECT "case", action, count(*) AS n FROM p GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY n DESC, action) AS rn FROM c) SELECT "case", CASE WHEN n >= 3 THEN action ELSE 'HOLD' END AS choice FROM k WHERE rn = 1""")
def m11_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int"))
    return e.ensemble(s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), action.alias("action")), 3, F.lit("HOLD"))


@query("m03_rate_outcomes", f"""WITH {s.VINTAGES_SQL}, {s.CUTOFFS_SQL}, vis AS (SELECT meeting_id, cutoff, series_id, observation_date, max(realtime_start) AS rt, arg_max(value, realtime_start) AS value FROM vint JOIN cut ON observation_date <= cutoff AND realtime_start <= cutoff WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4),
pre AS (SELECT meeting_id, series_id, arg_max(value, observation_date) AS pre FROM vis GROUP BY 1, 2),
post AS (SELECT meeting_id, series_id, value AS post FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, series_id ORDER BY observation_date, realtime_start DESC) AS rn FROM vint JOIN cut ON observation_date > cutoff) WHERE rn = 1)
SELECT meeting_id, series_id, pre, post, CASE WHEN post - pre > 1e-9 THEN 'HIKE' WHEN post - pre < -1e-9 THEN 'CUT' ELSE 'HOLD' END AS action FROM pre JOIN post USING (meeting_id, series_id)""")
def m03_rate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = s.vintages(spark, sf_dir), s.cutoffs(spark, sf_dir)
    pre = t.as_of_join(v, c).select("meeting_id", "series_id", F.col("value").alias("pre"))
    post = t.first_after(v, c.withColumnRenamed("cutoff", "at")).select("meeting_id", "series_id", F.col("value").alias("post"))
    change = F.col("post") - F.col("pre")
    return pre.join(post, ["meeting_id", "series_id"]).withColumn("action", F.when(change > 1e-9, "HIKE").when(change < -1e-9, "CUT").otherwise("HOLD"))


_SEEN = "(SELECT arg_max(value, (observation_date, realtime_start)) FROM vint v WHERE v.series_id = '{0}' AND observation_date <= cutoff AND realtime_start <= cutoff AND value IS NOT NULL)"


@query("m03_rate_switch", f"""WITH {s.VINTAGES_SQL}, mt AS (SELECT DISTINCT 'D-' || (ts::DATE)::VARCHAR AS meeting_id, ts::DATE AS cutoff, ts::DATE + 2 AS ended FROM events),
nw AS (SELECT series_id, observation_date AS d, arg_max(value, realtime_start) AS v FROM vint WHERE value IS NOT NULL GROUP BY 1, 2), rg AS (SELECT a.d, a.v AS l, b.v AS u FROM nw a JOIN nw b ON a.d = b.d AND a.series_id = 'view' AND b.series_id = 'signup'), tg AS (SELECT d, v FROM nw WHERE series_id = 'click'),
k AS (SELECT *, cutoff < DATE '2024-01-16' AS old, CASE WHEN cutoff < DATE '2024-01-16' AND ended < DATE '2024-01-16' THEN (SELECT min(d) FROM tg WHERE d > ended) END AS td, CASE WHEN cutoff < DATE '2024-01-16' AND ended >= DATE '2024-01-16' THEN (SELECT min(d) FROM rg WHERE d >= ended)
WHEN cutoff >= DATE '2024-01-16' THEN (SELECT min(d) FROM rg WHERE d > ended) END AS rd, {_SEEN.format('click')} AS t0, {_SEEN.format('view')} AS l0, {_SEEN.format('signup')} AS u0 FROM mt),
x AS (SELECT meeting_id, CASE WHEN old THEN t0 END AS pre_target, CASE WHEN NOT old THEN l0 END AS pre_lower, CASE WHEN NOT old THEN u0 END AS pre_upper, tg.v AS post_target, l AS post_lower, u AS post_upper, coalesce(td, rd) AS effective FROM k LEFT JOIN tg ON tg.d = td LEFT JOIN rg ON rg.d = rd)
SELECT *, CASE WHEN c > 1e-9 THEN 'HIKE' WHEN c < -1e-9 THEN 'CUT' WHEN c IS NOT NULL THEN 'HOLD' END AS action FROM (SELECT *, coalesce(post_target, (post_lower + post_upper) / 2) - coalesce(pre_target, (pre_lower + pre_upper) / 2) AS c FROM x)""".replace("SELECT *, CASE WHEN c >", "SELECT * EXCLUDE (c), CASE WHEN c >"))
def m03_rate_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting a day, two days long; from the middle of the month on the rate is a range of two other series."""
    day = F.to_date("ts")
    meetings = s.table(spark, sf_dir, "events").select(day.alias("cutoff")).distinct()
    meetings = meetings.select(F.concat(F.lit("D-"), F.col("cutoff").cast("string")).alias("meeting_id"), "cutoff", F.date_add("cutoff", 2).alias("ended"))
    return e.rate_outcomes(meetings, s.vintages(spark, sf_dir), "2024-01-16", "click", "view", "signup")


@query("m15_m18_lags", f"""WITH {EVENTS_SQL}, f AS (SELECT assumption_id, min(occurred_at) FILTER (kind = 'CONTRADICTION') AS c FROM ev GROUP BY 1),
s AS (SELECT f.assumption_id, c, (SELECT min(occurred_at) FROM ev WHERE ev.assumption_id = f.assumption_id AND kind = 'STATEMENT_FLIP' AND occurred_at >= c) AS flip FROM f),
p AS (SELECT *, (SELECT min(occurred_at) FROM ev WHERE ev.assumption_id = s.assumption_id AND kind = 'POLICY_RESPONSE' AND occurred_at >= flip) AS response FROM s)
SELECT assumption_id, (flip::DATE - c::DATE)::INTEGER AS recognition_days, (response::DATE - flip::DATE)::INTEGER AS action_days,
CASE WHEN flip IS NULL THEN 'NO_STATEMENT_FLIP_AS_OF' WHEN response IS NULL THEN 'RIGHT_CENSORED' ELSE 'OBSERVED' END AS status FROM p WHERE c IS NOT NULL""")
def m15_m18_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, kind, at = assumption_events(spark, sf_dir), F.col("kind"), F.col("occurred_at")
    first = events.groupBy("assumption_id").agg(F.min(F.when(kind == "CONTRADICTION", at)).alias("c")).filter("c is not null")
    flips = events.join(first, "assumption_id").groupBy("assumption_id", "c").agg(F.min(F.when((kind == "STATEMENT_FLIP") & (at >= F.col("c")), at)).alias("flip"))
    done = events.join(flips, "assumption_id").groupBy("assumption_id", "c", "flip").agg(F.min(F.when((kind == "POLICY_RESPONSE") & (at >= F.col("flip")), at)).alias("response"))
    days = lambda a, b: F.date_diff(F.to_date(b), F.to_date(a))
    status = F.when(F.col("flip").isNull(), "NO_STATEMENT_FLIP_AS_OF").when(F.col("response").isNull(), "RIGHT_CENSORED").otherwise("OBSERVED")
    return done.select("assumption_id", days("c", "flip").alias("recognition_days"), days("flip", "response").alias("action_days"), status.alias("status"))


@query("m04_ordered_logit")
def m04_ordered_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, coefficient of actions (by order status) on standardised price and size of an order, and the cuts."""
    lines = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("meeting")).agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    rows = s.outcomes(spark, sf_dir).join(lines, "meeting")
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("level", "q", "d") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    label = F.when(F.col("action") == "CUT", 0).when(F.col("action") == "HOLD", 1).otherwise(2)
    scaled = rows.select(label.alias("y"), *[((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(c) for c in ("level", "q", "d")]).persist()
    theta, trace = e.fit_ordered_logit(scaled, ["level", "q", "d"], "y")
    scaled.unpersist()
    names = ["level", "q", "d", "first_cut", "log_width", "log_likelihood"]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, [*theta, trace[-1]], strict=True)], "feature string, coefficient double")


def _versioned_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations; every third is a version of up to two days later."""
    version = F.date_add(F.to_date("ts"), F.pmod("event_id", F.lit(3)).cast("int"))
    return s.table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "event_id", "ts", version.alias("version_on"), "value")


@query("t01_contradictions", """WITH passing AS (SELECT event_type AS series_id, ts, event_id FROM events
  WHERE value > 60 AND ts > TIMESTAMP '2024-01-10' AND ts::DATE + (event_id % 3)::INTEGER <= ts::DATE)
SELECT series_id, ts AS contradicted_at, event_id FROM passing p
WHERE NOT EXISTS (SELECT 1 FROM passing q WHERE q.series_id = p.series_id AND (q.ts < p.ts OR q.ts = p.ts AND q.event_id < p.event_id))""")
def t01_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.first_contradictions(_versioned_observations(spark, sf_dir), 60.0, "2024-01-10")


@query("t02_accepted_events", f"""WITH {EVENTS_SQL},
con AS (SELECT assumption_id, min((occurred_at, event_id)) AS first FROM ev WHERE kind = 'CONTRADICTION' GROUP BY 1),
req AS (SELECT e.assumption_id, min((occurred_at, event_id)) AS first FROM ev e JOIN con USING (assumption_id) WHERE kind = 'REVIEW_REQUESTED' AND (occurred_at, event_id) > con.first GROUP BY 1),
flip AS (SELECT e.assumption_id, min((occurred_at, event_id)) AS first FROM ev e JOIN con USING (assumption_id) WHERE kind = 'STATEMENT_FLIP' AND (occurred_at, event_id) > con.first GROUP BY 1)
SELECT e.assumption_id, kind, occurred_at, event_id, kind = 'CONTRADICTION'
  OR kind IN ('REVIEW_REQUESTED', 'STATEMENT_FLIP') AND coalesce((occurred_at, event_id) > con.first, false)
  OR kind = 'REVIEWED' AND coalesce((occurred_at, event_id) > req.first, false)
  OR kind IN ('POLICY_RESPONSE', 'CENSORED') AND coalesce((occurred_at, event_id) > flip.first, false) AS accepted
FROM ev e LEFT JOIN con USING (assumption_id) LEFT JOIN req USING (assumption_id) LEFT JOIN flip USING (assumption_id)""")
def t02_accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.accepted_events(assumption_events(spark, sf_dir))


@query("t03_event_once", f"WITH {EVENTS_SQL} SELECT DISTINCT assumption_id, kind, occurred_at FROM ev")
def t03_event_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a table in two batches that overlap, the second of them twice."""
    events = assumption_events(spark, sf_dir).select("assumption_id", "kind", "occurred_at")
    table = VersionedTable.create(spark, f"{scratch_dir(spark)}/events-{uuid.uuid4().hex}", events.schema, events.columns, buckets=16)
    early = F.col("occurred_at") < F.lit("2024-01-20").cast("timestamp_ntz")
    for number, batch in enumerate((events.filter(early), events, events)):
        table.append_new(batch, batch_of=("events", min(number, 1)))
    return table.read()


@query("t04_late_documents", "SELECT source, count(*) FILTER (d <= DATE '2024-02-01') AS in_time, count(*) FILTER (d > DATE '2024-02-01') AS late FROM (SELECT source, DATE '2024-01-01' + (doc_id % 60)::INTEGER AS d FROM documents) GROUP BY 1")
def t04_late_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int"))
    return m.late_counts(s.table(spark, sf_dir, "documents").withColumn("published", published), "2024-02-01")


@query("t05_current_states", f"WITH {EVENTS_SQL} SELECT assumption_id, min(occurred_at) FILTER (kind = 'CONTRADICTION') AS contradicted_at, min(occurred_at) FILTER (kind = 'REVIEWED') AS reviewed_at, count(*) AS n_events FROM ev GROUP BY 1")
def t05_current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.current_states(assumption_events(spark, sf_dir))


@query("m09_date_probe", f"{_PERSIST}, o AS (SELECT *, CASE predicted WHEN 'CUT' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END AS a, CASE actual WHEN 'CUT' THEN 0 WHEN 'HOLD' THEN 1 ELSE 2 END AS b FROM p) SELECT actual, avg(abs(a - b)) AS mean_error, count(*) FILTER (a = b) AS hits FROM o GROUP BY 1")
def m09_date_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda c: F.array_position(F.array(*[F.lit(k) for k in CLASSES]), F.col(c))
    error = F.abs(place("predicted") - place("actual"))
    return _persistence(spark, sf_dir).groupBy("actual").agg(F.avg(error).alias("mean_error"), F.count_if(error == 0).alias("hits"))


@query("m10_promotion_gate", f"{_TRACE}, b AS (SELECT max(f1) AS reference FROM tr WHERE threshold = 0.5) SELECT threshold, f1 > reference AS promoted, list_filter([CASE WHEN f1 <= reference THEN 'F1' END, CASE WHEN tp + fp = 0 THEN 'NO_COVERAGE' END], lambda z: z IS NOT NULL) AS blockers FROM tr, b")
def m10_promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = m07_threshold_trace(spark, sf_dir)
    reference = trace.filter("threshold = 0.5").agg(F.max("f1")).first()[0]  # one number
    better = F.col("f1") > F.lit(reference)
    blockers = F.array_compact(F.array(F.when(~better, "F1"), F.when(F.col("tp") + F.col("fp") == 0, "NO_COVERAGE")))
    return trace.select("threshold", better.alias("promoted"), blockers.alias("blockers"))


@query("b14_review_results", "SELECT coalesce(s.doc_id, r.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'MISSING' WHEN s.doc_id IS NULL THEN 'UNKNOWN' WHEN quality = 1 AND toxic = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS decision FROM (SELECT doc_id FROM documents WHERE lang = 'en') s FULL JOIN labels r ON s.doc_id = r.doc_id")
def b14_review_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = s.table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", F.lit(True).alias("sampled"))
    joined = sample.join(s.table(spark, sf_dir, "labels"), "doc_id", "full_outer")
    decision = F.when(F.col("quality").isNull(), "MISSING").when(F.col("sampled").isNull(), "UNKNOWN")
    return joined.select("doc_id", decision.when((F.col("quality") == 1) & (F.col("toxic") == 0), "APPROVED").otherwise("REJECTED").alias("decision"))


