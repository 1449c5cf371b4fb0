"""Queries over the point-in-time operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as t
from ..sources import tables as s
from .registry import query

LIMITS = {"view": 5, "click": 8}
_LIMIT_SQL = "CASE series_id WHEN 'view' THEN 5 WHEN 'click' THEN 8 ELSE 3 END"
_WITH = f"WITH {s.VINTAGES_SQL}, {s.CUTOFFS_SQL}"
_VISIBLE = f"""{_WITH}, vis AS (
  SELECT meeting_id, cutoff, series_id, observation_date, max(realtime_start) AS realtime_start, arg_max(value, realtime_start) AS value
  FROM vint JOIN cut ON observation_date <= cutoff AND realtime_start <= cutoff WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_SNAPSHOT = f"""{_VISIBLE}, snap AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY meeting_id, series_id ORDER BY observation_date DESC) AS rn FROM vis) WHERE rn <= {_LIMIT_SQL})"""
_AS_OF = f"""{_VISIBLE}
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, series_id ORDER BY observation_date DESC) AS rn FROM vis) WHERE rn = 1"""


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.snapshot(s.vintages(spark, sf_dir), s.cutoffs(spark, sf_dir), LIMITS, 3)


query("w02_snapshot", f"{_SNAPSHOT} SELECT * FROM snap")(_snapshot)


@query("p01_visible", f"""WITH {s.VINTAGES_SQL}, c AS (SELECT max(ts::DATE) - 10 AS cutoff FROM events)
SELECT series_id, observation_date, realtime_start, realtime_end, value FROM vint, c
WHERE observation_date <= cutoff AND realtime_start <= cutoff AND value IS NOT NULL""")
def p01_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = s.table(spark, sf_dir, "events").agg(F.date_sub(F.max(F.to_date("ts")), 10)).first()[0]
    return t.visible(s.vintages(spark, sf_dir), F.lit(day))


@query("p03_leakage", f"{_SNAPSHOT} SELECT meeting_id, count(*) AS n_rows, count(*) FILTER (observation_date > cutoff OR realtime_start > cutoff) AS n_leaks FROM snap GROUP BY 1")
def p03_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.leakage(_snapshot(spark, sf_dir))


@query("j07_as_of_join", _AS_OF)
def j07_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.as_of_join(s.vintages(spark, sf_dir), s.cutoffs(spark, sf_dir))


@query("j07_as_of_union", _AS_OF)
def j07_as_of_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.as_of_union(s.vintages(spark, sf_dir), s.cutoffs(spark, sf_dir))


@query("w01_latest_version", f"""WITH {s.VINTAGES_SQL} SELECT series_id, observation_date, max(realtime_start) AS realtime_start,
arg_max(value, realtime_start) AS value FROM vint GROUP BY 1, 2""")
def w01_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = s.vintages(spark, sf_dir).groupBy("series_id", "observation_date")
    return grouped.agg(F.max("realtime_start").alias("realtime_start"), F.max_by("value", "realtime_start").alias("value"))


@query("w03_latest_in_snapshot", f"{_SNAPSHOT} SELECT meeting_id, series_id, max(observation_date) AS observation_date, arg_max(value, observation_date) AS value FROM snap GROUP BY 1, 2")
def w03_latest_in_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _snapshot(spark, sf_dir).groupBy("meeting_id", "series_id")
    return grouped.agg(F.max("observation_date").alias("observation_date"), F.max_by("value", "observation_date").alias("value"))


@query("j01_snapshot_to_version", f"{_SNAPSHOT} SELECT s.meeting_id, s.series_id, s.observation_date, s.realtime_start, v.realtime_end, v.value FROM snap s JOIN vint v USING (series_id, observation_date, realtime_start)")
def j01_snapshot_to_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["series_id", "observation_date", "realtime_start"]
    return _snapshot(spark, sf_dir).select("meeting_id", *keys).join(s.vintages(spark, sf_dir), keys).select("meeting_id", *keys, "realtime_end", "value")


@query("j08_valid_at", f"""WITH {s.VINTAGES_SQL}, p AS (SELECT DISTINCT series_id, observation_date, observation_date + 1 AS "at" FROM vint)
SELECT series_id, observation_date, "at", realtime_start, realtime_end, value FROM p JOIN vint USING (series_id, observation_date)
WHERE "at" BETWEEN realtime_start AND realtime_end""")
def j08_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = s.vintages(spark, sf_dir)
    points = v.select("series_id", "observation_date", F.date_add("observation_date", 1).alias("at")).distinct()
    return t.valid_at(v, points).select("series_id", "observation_date", "at", "realtime_start", "realtime_end", "value")


@query("a01_first_releases", f"""WITH {s.VINTAGES_SQL} SELECT *, value IS NOT NULL AND realtime_start = min(CASE WHEN value IS NOT NULL THEN realtime_start END)
OVER (PARTITION BY series_id, observation_date) AS is_initial_release FROM vint""")
def a01_first_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.first_releases(s.vintages(spark, sf_dir))


@query("j09_year_ago_strict", """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
SELECT day, try_cast((year(day) - 1)::VARCHAR || strftime(day, '-%m-%d') AS DATE) AS year_ago FROM d""")
def j09_year_ago_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.year_ago_strict(s.outcomes(spark, sf_dir).select(F.col("decided_on").alias("day")).distinct())


@query("j10_year_ago_clamped", "SELECT DISTINCT o_orderdate::DATE AS day, (o_orderdate::DATE - INTERVAL 1 YEAR)::DATE AS year_ago FROM orders")
def j10_year_ago_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.year_ago_clamped(s.outcomes(spark, sf_dir).select(F.col("decided_on").alias("day")).distinct())


def _first_after_sql(op: str) -> str:
    return f"""{_WITH}, j AS (SELECT meeting_id, cutoff AS "at", series_id, observation_date, realtime_start, value,
row_number() OVER (PARTITION BY meeting_id, series_id ORDER BY observation_date, realtime_start DESC) AS rn FROM vint JOIN cut ON observation_date {op} cutoff)
SELECT * EXCLUDE (rn) FROM j WHERE rn = 1"""


@query("j11_first_after", _first_after_sql(">"))
def j11_first_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.first_after(s.vintages(spark, sf_dir), s.cutoffs(spark, sf_dir).withColumnRenamed("cutoff", "at"))


@query("j11_first_on_or_after", _first_after_sql(">="))
def j11_first_on_or_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.first_after(s.vintages(spark, sf_dir), s.cutoffs(spark, sf_dir).withColumnRenamed("cutoff", "at"), inclusive=True)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    levels = s.daily_levels(spark, sf_dir)
    pick = lambda name, every: levels.filter((F.col("series_id") == name) & (F.pmod(F.dayofyear("day"), F.lit(every)) == 0))
    return pick("view", 2), pick("click", 3)


_TWO_SQL = f"""WITH {s.LEVELS_SQL}, a AS (SELECT day, level FROM lev WHERE series_id = 'view' AND dayofyear(day) % 2 = 0),
b AS (SELECT day, level FROM lev WHERE series_id = 'click' AND dayofyear(day) % 3 = 0)"""


@query("j12_series_pair", f"{_TWO_SQL} SELECT day, a.level AS lower_level, b.level AS upper_level FROM a JOIN b USING (day)")
def j12_series_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return a.select("day", F.col("level").alias("lower_level")).join(b.select("day", F.col("level").alias("upper_level")), "day")


@query("j13_carried_axis", f"""{_TWO_SQL}, x AS (SELECT coalesce(a.day, b.day) AS day, a.level AS l, b.level AS r FROM a FULL JOIN b ON a.day = b.day),
y AS (SELECT day, last_value(l IGNORE NULLS) OVER w AS left_level, last_value(r IGNORE NULLS) OVER w AS right_level FROM x WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT * FROM y WHERE left_level IS NOT NULL AND right_level IS NOT NULL""")
def j13_carried_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.carried_axis(*_two(spark, sf_dir))


@query("j15_nearest_within", f"""{_TWO_SQL}, j AS (SELECT a.day, b.day AS other_day,
row_number() OVER (PARTITION BY a.day ORDER BY abs(b.day - a.day), a.day - b.day) AS rn FROM a JOIN b ON b.day BETWEEN a.day - 3 AND a.day + 3)
SELECT day, other_day FROM j WHERE rn = 1""")
def j15_nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return t.nearest_within(a.select("day"), b.select(F.col("day").alias("other_day")), 3)


_CHANGES = f"""WITH {s.LEVELS_SQL}, chg AS (SELECT series_id, day, level FROM (SELECT *, lag(level) OVER w AS b, row_number() OVER w AS rn FROM lev
WINDOW w AS (PARTITION BY series_id ORDER BY day)) WHERE rn = 1 OR level IS DISTINCT FROM b),
dir AS (SELECT series_id, day, level, CASE WHEN b IS NULL THEN 'INITIAL' WHEN level > b THEN 'UP' WHEN level < b THEN 'DOWN' ELSE 'UNCHANGED' END AS direction
FROM (SELECT *, lag(level) OVER (PARTITION BY series_id ORDER BY day) AS b FROM chg))"""


@query("w04_change_points", f"{_CHANGES} SELECT * FROM chg")
def w04_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.change_points(s.daily_levels(spark, sf_dir))


@query("w05_directions", f"{_CHANGES} SELECT * FROM dir")
def w05_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.directions(w04_change_points(spark, sf_dir))


@query("w06_regime_starts", f"""{_CHANGES}, k AS (SELECT *, CASE WHEN level <= 1 THEN 'FLOOR' ELSE direction END AS kind FROM dir),
r AS (SELECT *, sum(CASE WHEN kind IS NOT DISTINCT FROM pk THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, lag(kind) OVER (PARTITION BY series_id ORDER BY day) AS pk FROM k))
SELECT series_id, day, level, direction, kind, min(day) OVER (PARTITION BY series_id, run) AS regime_start FROM r""")
def w06_regime_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.regime_starts(w05_directions(spark, sf_dir), 1.0)


@query("w07_rate_context", f"""{_CHANGES}, {s.CUTOFFS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, series_id ORDER BY day DESC) AS rn FROM dir JOIN cut ON day <= cutoff)
SELECT meeting_id, series_id, 0 AS ordinal, 'CURRENT' AS kind, day, level, direction, (cutoff - day)::INTEGER AS duration_days FROM k WHERE rn = 1
UNION ALL SELECT meeting_id, series_id, rn::INTEGER, 'CHANGE', day, level, direction, NULL FROM k WHERE rn <= 8""")
def w07_rate_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.rate_context(w05_directions(spark, sf_dir), s.cutoffs(spark, sf_dir))


@query("w08_prior_history", f"""WITH {s.VOTES_SQL} SELECT *, prior_dissents::DOUBLE / nullif(prior_votes, 0) AS prior_rate FROM (
SELECT meeting, participant, dissent, count(*) OVER p AS prior_votes, coalesce(sum(dissent::INT) OVER p, 0)::BIGINT AS prior_dissents,
coalesce(lag(dissent) OVER (PARTITION BY participant ORDER BY meeting), false) AS previous_dissent FROM mv
WINDOW p AS (PARTITION BY participant ORDER BY meeting ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def w08_prior_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.prior_history(s.member_votes(spark, sf_dir))


@query("w09_recency", f"""WITH {s.VOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY meeting DESC) AS rn FROM mv WHERE meeting < (SELECT max(meeting) FROM mv))
SELECT participant, avg(CASE WHEN rn <= 3 THEN dissent::INT END) AS recent3_rate, min(CASE WHEN dissent THEN rn END) - 1 AS votes_since_dissent,
max(CASE WHEN dissent THEN meeting END) AS last_dissent, list(meeting ORDER BY rn) FILTER (rn <= 8) AS newest_votes FROM r GROUP BY 1""")
def w09_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = s.member_votes(spark, sf_dir)
    return t.recency(votes, votes.agg(F.max("meeting")).first()[0])  # as of the newest meeting


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("desk"), F.col("o_orderkey").alias("meeting"))
    out = s.outcomes(spark, sf_dir)
    gap = F.pmod("meeting", F.lit(3)) == 0
    return o.join(out, "meeting").select(
        "desk", "meeting", F.when(~gap, F.col("action")).alias("action"), F.when(F.pmod("meeting", F.lit(5)) != 0, F.col("level")).alias("level")
    )


_GAPPY = f"""WITH {s.OUTCOMES_SQL}, g AS (SELECT o_custkey AS desk, meeting, CASE WHEN meeting % 3 <> 0 THEN action END AS action,
CASE WHEN meeting % 5 <> 0 THEN level END AS level FROM outc JOIN orders ON meeting = o_orderkey)"""
_ORDER = "PARTITION BY desk ORDER BY meeting ROWS BETWEEN UNBOUNDED PRECEDING AND"


@query("w10_persistence", f"{_GAPPY} SELECT desk, meeting, action, last_value(action IGNORE NULLS) OVER ({_ORDER} 1 PRECEDING) AS persisted FROM g")
def w10_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.persistence(_gappy(spark, sf_dir).drop("level"), "desk")


@query("w11_filled_levels", f"""{_GAPPY}, f AS (SELECT *, last_value(level IGNORE NULLS) OVER ({_ORDER} CURRENT ROW) AS filled,
last_value(level IGNORE NULLS) OVER ({_ORDER} 1 PRECEDING) AS b FROM g)
SELECT desk, meeting, action, level, filled, coalesce(action, CASE WHEN filled - b >= 0.05 THEN 'HIKE' WHEN filled - b <= -0.05 THEN 'CUT' WHEN filled - b IS NOT NULL THEN 'HOLD' END) AS imputed FROM f""")
def w11_filled_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.filled_levels(_gappy(spark, sf_dir), "desk")


@query("w12_monthly_growth", """WITH m AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS month, sum(round(o_totalprice)) AS level FROM orders GROUP BY 1, 2),
j AS (SELECT m.*, m.level / nullif(p.level, 0) - 1 AS growth, row_number() OVER (PARTITION BY m.series_id ORDER BY m.month DESC) AS rn
FROM m LEFT JOIN m p ON p.series_id = m.series_id AND p.month = (m.month - INTERVAL 1 YEAR)::DATE)
SELECT series_id, month, level, growth FROM j WHERE rn <= 24""")
def w12_monthly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = s.table(spark, sf_dir, "orders")
    return t.monthly_growth(orders.select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("day"), F.round("o_totalprice").alias("level")))


def assumption_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("MONITORED", "CONTRADICTION", "REVIEW_REQUESTED", "REVIEWED", "STATEMENT_FLIP", "POLICY_RESPONSE", "CENSORED")])
    kind = F.element_at(kinds, (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    return s.table(spark, sf_dir, "events").select(F.col("user_id").alias("assumption_id"), kind.alias("kind"), F.col("ts").alias("occurred_at"), "event_id")


EVENTS_SQL = """ev AS (SELECT user_id AS assumption_id, ts AS occurred_at, event_id, (['MONITORED', 'CONTRADICTION', 'REVIEW_REQUESTED', 'REVIEWED', 'STATEMENT_FLIP',
'POLICY_RESPONSE', 'CENSORED'])[(event_id % 7) + 1] AS kind FROM events)"""


@query("w13_review_states", f"""WITH {EVENTS_SQL}, f AS (SELECT assumption_id, min(occurred_at) FILTER (kind = 'MONITORED') AS monitored, min(occurred_at) FILTER (kind = 'CONTRADICTION') AS contradiction,
min(occurred_at) FILTER (kind = 'REVIEW_REQUESTED') AS review_requested, min(occurred_at) FILTER (kind = 'REVIEWED') AS reviewed FROM ev GROUP BY 1)
SELECT *, CASE WHEN reviewed IS NOT NULL THEN 'REVIEWED' WHEN review_requested IS NOT NULL THEN 'REVIEW_REQUESTED' WHEN contradiction IS NOT NULL THEN 'CONTRADICTED' ELSE 'MONITORED' END AS state,
trunc((epoch_us(review_requested) - epoch_us(contradiction)) / 1000000.0)::BIGINT AS recognition_lag_s FROM f""")
def w13_review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.review_states(assumption_events(spark, sf_dir))


@query("w14_even_sample", """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT DISTINCT source, position::INTEGER AS position, doc_id FROM r JOIN range(9) g(i) ON position = round_even(i * (n - 1) / 8.0, 0)""")
def w14_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.even_sample(s.table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", "source", 9).select("source", "position", "doc_id")


@query("w15_alerts", """WITH x AS (SELECT event_type AS "group", event_id AS id, ts AS "at", value > 50 AS support, user_id % 3 = 0 AS flip FROM events),
n AS (SELECT *, sum(("at" >= TIMESTAMP '2024-01-20' AND flip AND NOT support)::INT) OVER (PARTITION BY "group" ORDER BY "at", id ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT "group", id, "at", support, flip, CASE WHEN "at" < TIMESTAMP '2024-01-10' THEN 'PRE_ADOPTION' WHEN support AND flip THEN 'SUPPRESSED_SUPPORT_FLIP_COOCCURRENCE' WHEN support THEN 'SUPPORT'
WHEN flip AND "at" < TIMESTAMP '2024-01-20' THEN 'SUPPRESSED_PRE_CONTRADICTION' WHEN flip AND k = 1 THEN 'ALERT' WHEN flip THEN 'POST_ALERT_REPEAT' ELSE 'NO_MATCH' END AS class FROM n""")
def w15_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("group"), F.col("event_id").alias("id"), F.col("ts").alias("at"),
        (F.col("value") > 50).alias("support"), (F.pmod("user_id", F.lit(3)) == 0).alias("flip"),
    )
    moment = lambda day: F.lit(day).cast("timestamp_ntz")
    return t.classified_alerts(rows, moment("2024-01-10"), moment("2024-01-20"))
