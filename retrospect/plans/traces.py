"""Queries over decision traces, review queues, forecasts and bundles, spelled out from orders, lines and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases
from ..operators import records as rec
from ..operators import retrieval as ret
from ..operators import temporal as t
from ..operators import traces as tr
from ..sources import corpus as c
from ..sources import tables as s
from ..sources.scratch import staged
from .registry import query
from .retrieval import _ETA, _MODEL, _NUMBERS

CLASSES = ["CUT", "HOLD", "HIKE"]
_OUT = f"WITH {s.OUTCOMES_SQL}, {c.ROSTER_SQL}"


def _list_sql(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items()) + "], lambda z: z IS NOT NULL)"


def _trace_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, json: a trace for every order; some repeat an option, miscount votes or name another action."""
    no_refs = F.array().cast("array<struct<document_id:string,locator:string,excerpt:string>>")
    key = F.col("meeting")
    every = lambda n: F.pmod(key, F.lit(n)) == 0
    lines = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("meeting")).agg(
        F.collect_list(F.struct(F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("assumption_id"), F.concat(F.lit("claim "), F.col("l_partkey").cast("string")).alias("claim"),
                                F.col("l_returnflag").alias("monitor_series_id"), F.col("l_quantity").alias("threshold_value"), no_refs.alias("evidence_refs"))).alias("assumptions")
    )
    said = c.statements(spark, sf_dir).join(lines, "meeting", "left")
    option = lambda i, action, name=None: F.struct((F.lit(f"o{i}") if name is None else name).alias("option_id"), F.lit(action).alias("action_class"), no_refs.alias("evidence_refs"))
    ref = F.array(F.struct(key.cast("string").alias("document_id"), F.lit("paragraph 5").alias("locator"), F.when(every(7), "The Board decided").otherwise("The Committee decided").alias("excerpt")))
    debate = F.struct(F.when(every(2), "participant").otherwise("committee").alias("speaker_scope"), F.when(every(2), F.get("ids", F.lit(0)).cast("string")).alias("participant_id"), no_refs.alias("evidence_refs"))
    no, yes = F.coalesce(F.size("voted_against"), F.lit(0)), F.coalesce(F.size("voted_for"), F.lit(0))
    rounds = F.struct(F.array(F.struct(F.lit(1).alias("vote_round"), (yes + F.when(every(17), 1).otherwise(0)).alias("for_count"), no.alias("against_count"), no_refs.alias("evidence_refs"))).alias("rounds"))
    trace = F.struct(
        F.concat(F.lit("D-"), key.cast("string")).alias("decision_id"), F.when(~every(5), F.concat(F.lit("FOMC-"), key.cast("string"))).alias("meeting_id"),
        F.struct(F.lit("summary").alias("summary"), no_refs.alias("evidence_refs")).alias("context"),
        F.array(option(1, "CUT"), option(2, "HOLD"), option(3, "HIKE", F.when(every(11), "o2").otherwise("o3"))).alias("options"), F.array(debate).alias("debate"),
        F.struct(F.when(every(13), "HOLD").otherwise(F.col("action")).alias("action_class"), F.lit(None).cast("double").alias("target_lower"), F.lit(None).cast("double").alias("target_upper"), ref.alias("evidence_refs")).alias("decision"),
        rounds.alias("vote"), F.coalesce("assumptions", F.array().cast(lines.schema["assumptions"].dataType)).alias("assumptions"),
    )
    return c.dealt(said.select(key.alias("key"), F.to_json(trace).alias("json")), "key")


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.parsed_traces(_trace_json(spark, sf_dir))


def _references(spark: SparkSession, sf_dir: str, traces: DataFrame) -> DataFrame:
    """key, path, participant, found, owner of every reference, and one for each debate item whose speaker is known."""
    flat = cases.evidence_references(traces, "key")
    units = c.statements(spark, sf_dir).select(F.col("meeting").cast("string").alias("doc_id"), F.col("statement").alias("text"))
    named = flat.select("key", "path", F.col("document_id").alias("doc_id"), "locator", "excerpt")
    none = F.lit(None).cast("string")
    found = rec.located(named, units).select("key", "path", none.alias("participant"), "found", none.alias("owner"))
    spoken = traces.select("key", F.explode("debate").alias("d")).filter("d.participant_id is not null")
    owner = F.when(F.pmod("key", F.lit(3)) == 0, "someone else").otherwise(F.col("d.participant_id"))
    return found.unionByName(spoken.select("key", F.lit("debate").alias("path"), F.col("d.participant_id").alias("participant"), F.lit(True).alias("found"), owner.alias("owner")))


_N = f"""{_OUT}, n AS (SELECT o_orderkey AS key, action, coalesce(k, 0) AS k, coalesce(d, 0) AS d, coalesce(u, 0) AS u, names IS NOT NULL AS voted, voted_for, voted_against FROM orders JOIN outc ON meeting = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS k, count(DISTINCT l_linenumber) AS d, count(*) FILTER (l_returnflag = 'R') AS u FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN sides ON sides.meeting = o_orderkey)"""


@query("d12_parsed_traces", f"{_N} SELECT key, 'D-' || key AS decision_id, 3 AS n_options, k::INTEGER AS n_assumptions, CASE WHEN key % 13 = 0 THEN 'HOLD' ELSE action END AS action_class, {_list_sql({'ASSUMPTIONS': 'k = 0'})} AS malformed FROM n")
def d12_parsed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).select("key", "decision_id", F.size("options").alias("n_options"), F.size("assumptions").alias("n_assumptions"), F.col("decision.action_class").alias("action_class"), "malformed")


_VIOLATIONS = {
    "ASSUMPTIONS": "k = 0", "OPTION_REPEATED": "key % 11 = 0", "ASSUMPTION_REPEATED": "k > d", "EXCERPT_NOT_FOUND": "key % 7 = 0", "FOREIGN_ATTRIBUTION": "key % 6 = 0 AND voted",
    "ACTION_MISMATCH": "key % 13 = 0 AND action <> 'HOLD'", "VOTE_MISMATCH": "key % 17 = 0", "MONITOR_UNKNOWN": "u > 0",
}


def _violations(spark: SparkSession, sf_dir: str, traces: DataFrame | None = None) -> DataFrame:
    """Traces are read once and written, not parsed again for their references, debates, monitors and rules."""
    traces = staged(_traces(spark, sf_dir), "traces") if traces is None else traces
    said = c.statements(spark, sf_dir)
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    labels = said.select(F.col("meeting").alias("key"), F.col("action").alias("action_class"), size("voted_for").alias("votes_for"), size("voted_against").alias("votes_against"))
    series = s.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id")).distinct().filter("series_id <> 'R'")
    return tr.trace_violations(traces, _references(spark, sf_dir, traces), labels, series)


@query("b07_trace_validation", f"{_N} SELECT key, {_list_sql(_VIOLATIONS)} AS violations FROM n")
def b07_trace_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir)


_ENTERPRISE = {
    "MEETING": "key % 5 <> 0", "OPTION_REPEATED": "key % 11 = 0", "ASSUMPTION_REPEATED": "k > d", "EXCERPT_NOT_FOUND": "key % 7 = 0", "ATTRIBUTED": "key % 2 = 0", "ACTION": "true",
    "EMPTY_ROUND": "NOT voted AND key % 17 <> 0", "MONITOR": "odd > 0",
}


@query("b08_enterprise_validation", f"{_N}, o AS (SELECT l_orderkey AS key, count(*) FILTER (l_quantity <> q) AS odd FROM lineitem JOIN (SELECT 'a' || l_linenumber AS a, max(l_quantity) AS q FROM lineitem GROUP BY 1) ON a = 'a' || l_linenumber GROUP BY 1) SELECT key, {_list_sql(_ENTERPRISE)} AS violations FROM n LEFT JOIN o USING (key)".replace("odd > 0", "coalesce(odd, 0) > 0"))
def b08_enterprise_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry holds one threshold for each assumption id; claims are compared without their part."""
    traces = staged(_traces(spark, sf_dir), "traces").withColumn("assumptions", F.transform("assumptions", lambda a: a.withField("claim", F.lit("claim")).withField("monitor_series_id", F.lit("x"))))
    lines = s.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("assumption_id")).agg(F.max("l_quantity").alias("threshold_value"))
    registry = lines.select("assumption_id", F.lit("claim").alias("claim"), F.lit("x").alias("monitor_series_id"), "threshold_value")
    return tr.enterprise_violations(traces, _references(spark, sf_dir, traces).filter("path <> 'debate'"), registry)


@query("b11_repaired_excerpts")
def b11_repaired_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints are a text's words 5 to 20, some with a word changed, against the whole text."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    own = F.array_join(F.slice(words, 5, 16), " ")
    changed = F.concat(F.array_join(F.slice(words, 5, 8), " "), F.lit(" XYZ "), F.array_join(F.slice(words, 14, 7), " "))
    hint = F.when(F.pmod("doc_id", F.lit(3)) == 0, own).otherwise(changed)
    return tr.repaired_excerpts(spark, s.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), hint.alias("hint"), F.col("text").alias("unit")))


_FLAGS = {
    "NO_PARTICIPANT_LEVEL_DEBATE": "NOT (key % 2 = 0 AND voted)", "NO_TRANSCRIPT_EVIDENCE": "key % 10 = 0", "SEMANTIC_REPAIR_USED": "key % 997 = 0",
    "ATTRIBUTION_DEMOTED_TO_COMMITTEE": "key % 31 = 0", "MISMATCHED_ATTRIBUTION_REFERENCE_REMOVED": "key % 37 = 0",
}
_QUEUE = f"{_N}, q AS (SELECT key AS \"case\", {_list_sql(_FLAGS)} AS flags, len({_list_sql(_VIOLATIONS)}) = 0 AS valid FROM n)"


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces, every = staged(_traces(spark, sf_dir), "traces"), lambda n: (F.pmod("key", F.lit(n)) == 0).cast("int")
    spoken = F.size(F.filter("debate", lambda d: d["participant_id"].isNotNull()))
    runs = traces.select("key", spoken.alias("participant_items"), (1 - every(10)).alias("transcript_references"), (1 + every(997)).alias("attempts"), every(31).alias("demoted"), every(37).alias("removed"))
    return tr.review_queue(runs.join(_violations(spark, sf_dir, traces), "key").withColumnRenamed("key", "case"))


@query("b12_review_queue", f"{_QUEUE} SELECT \"case\", flags, CASE WHEN len(flags) > 0 THEN 'HIGH' ELSE 'STANDARD' END AS priority, valid FROM q")
def b12_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir)


@query("b12_queue_summary", f"{_QUEUE} SELECT CASE WHEN len(flags) > 0 THEN 'HIGH' ELSE 'STANDARD' END AS priority, count(*) AS cases, count(*) FILTER (valid) AS valid FROM q GROUP BY 1")
def b12_queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.queue_summary(_queue(spark, sf_dir))


_RANK = "sha256('seed|{0}|' || \"case\")"


def _representatives() -> str:
    """Common table expressions c0, c1, ... that cover the flags in their order, one after the other."""
    out = ["c0 AS (SELECT \"case\", flags, 'ALL_SEMANTIC_REPAIRS' AS reason FROM q WHERE list_contains(flags, 'SEMANTIC_REPAIR_USED'))"]
    for i, flag in enumerate(sorted(_FLAGS)):
        out.append(f"""c{i + 1} AS (SELECT * FROM c{i} UNION ALL (SELECT "case", flags, 'FLAG_REPRESENTATIVE:{flag}' FROM q WHERE list_contains(flags, '{flag}')
AND NOT EXISTS (SELECT 1 FROM c{i} WHERE list_contains(c{i}.flags, '{flag}')) ORDER BY {_RANK.format(f'FLAG:{flag}')} LIMIT 1))""")
    return ", ".join(out)


_LAST = f"c{len(_FLAGS)}"


@query("b13_review_sample", f"""{_QUEUE}, {_representatives()}, p AS (SELECT "case", list(reason) AS reasons FROM {_LAST} GROUP BY 1), st AS (SELECT "case", ['STANDARD_HASH_SAMPLE'] AS reasons, row_number() OVER (ORDER BY {_RANK.format('STANDARD')}) AS k FROM q WHERE len(flags) = 0 AND "case" NOT IN (SELECT "case" FROM p)),
u AS (SELECT * FROM p UNION ALL SELECT "case", reasons FROM st WHERE k <= 200 - (SELECT count(*) FROM p)), f AS (SELECT "case", ['HASH_FILL'] AS reasons, row_number() OVER (ORDER BY {_RANK.format('FALLBACK')}) AS k FROM q WHERE "case" NOT IN (SELECT "case" FROM u))
SELECT * FROM u UNION ALL SELECT "case", reasons FROM f WHERE k <= 200 - (SELECT count(*) FROM u)""")
def b13_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.review_sample(staged(_queue(spark, sf_dir), "review-queue"), 200, "seed")


#: Model n of a meeting says what its line n says; members are the meeting's suppliers.
_PRED = f"""{_OUT}, pr AS (SELECT l_orderkey AS "case", l_linenumber AS model, (['CUT', 'HOLD', 'HIKE'])[l_suppkey % 3 + 1] AS action FROM lineitem),
lead AS (SELECT "case", action, count(*) AS n, row_number() OVER (PARTITION BY "case" ORDER BY count(*) DESC, action) AS k FROM pr GROUP BY 1, 2), mods AS (SELECT "case", count(*) AS models, count(DISTINCT model) AS d FROM pr GROUP BY 1),
vt AS (SELECT meeting AS "case", participant, count(*) FILTER ((participant + l_linenumber) % 4 = 0) AS a FROM ros JOIN lineitem ON l_orderkey = meeting GROUP BY 1, 2),
com AS (SELECT m."case", CASE WHEN n >= 3 THEN l.action ELSE 'HOLD' END AS action, n AS support, models, n >= 3 AS consensus, list(CASE WHEN a >= 2 THEN 'AGAINST' ELSE 'FOR' END ORDER BY participant) AS votes, CASE WHEN d < models THEN 'DUPLICATE_MODEL' END AS problem
FROM mods m JOIN lead l ON l."case" = m."case" AND k = 1 JOIN vt ON vt."case" = m."case" GROUP BY ALL)"""


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = c.rosters(spark, sf_dir).select(F.col("meeting").alias("case"), "ids")
    action = F.element_at(F.array(*[F.lit(x) for x in CLASSES]), (F.pmod("l_suppkey", F.lit(3)) + 1).cast("int"))
    lines = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("model"), action.alias("action"))
    vote = F.map_from_entries(F.transform("ids", lambda p: F.struct(p, F.when(F.pmod(p + F.col("model"), F.lit(4)) == 0, "AGAINST").otherwise("FOR"))))
    predictions = lines.join(roster, "case").select("case", "model", "action", vote.alias("votes"))
    return tr.combined_forecast(predictions, roster.select("case", F.col("ids").alias("members")), roster.select("case", F.lit("HOLD").alias("fallback")))


@query("m11_combined_forecast", f"{_PRED} SELECT * FROM com")
def m11_combined_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir).withColumn("votes", F.transform("votes", lambda v: v["vote"])).withColumn("support", F.col("support").cast("long"))


@query("m21_revalidated", f"""{_PRED} SELECT "case", {_list_sql({'CUTOFF': 'meeting % 9 = 0', 'LOCK': 'meeting % 8 = 0', 'VARIANTS': 'meeting % 12 = 0', 'MODELS': 'problem IS NOT NULL', 'ACTION': "meeting % 10 = 0 AND com.action <> 'CUT'", 'VOTES': 'meeting % 14 = 0'})} AS blockers FROM com JOIN outc ON meeting = "case" """)
def m21_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forecasts are the combination, some of them with a late date, a missing model or another result."""
    made = _combined(spark, sf_dir)
    every = lambda n: F.pmod("case", F.lit(n)) == 0
    day = F.col("decided_on")
    said = F.transform("votes", lambda v: v["vote"])
    models = F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"))
    stored = made.join(s.outcomes(spark, sf_dir).select(F.col("meeting").alias("case"), "decided_on"), "case").select(
        "case", F.when(every(9), day).otherwise(F.date_sub(day, 2)).alias("as_of"), F.when(~every(8), F.date_sub(day, 1)).alias("locked_on"), day.alias("starts_on"),
        F.when(every(12), F.slice(models, 1, 2)).otherwise(models).alias("variants"), F.when(every(10), "CUT").otherwise(F.col("action")).alias("action"),
        F.when(every(14), F.array_append(said, F.lit("FOR"))).otherwise(said).alias("votes"),
    )
    return tr.revalidated(stored, made, ["m1", "m2", "m3"])


_FORE = f"""{_PRED}, nb AS (SELECT o_orderkey AS "case", (o_custkey % 2) = 0 AS is_cut, """ + ", ".join(f"({x.format(k='o_orderkey')})::DOUBLE AS {n}" for n, x in _NUMBERS.items()) + f""" FROM orders),
lg AS (SELECT "case", CASE WHEN is_cut THEN 'CUT' ELSE 'HOLD' END AS pa, 1 / (1 + exp({_ETA} - {_MODEL['cutpoints'][0]})) AS l, 1 / (1 + exp({_ETA} - {_MODEL['cutpoints'][1]})) AS h FROM nb),
ch AS (SELECT *, CASE greatest(round(l, 9), round(h - l, 9), round(1 - h, 9)) WHEN round(l, 9) THEN 'CUT' WHEN round(h - l, 9) THEN 'HOLD' ELSE 'HIKE' END AS la FROM lg)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = {n: F.expr(x.format(k="cast(o_orderkey as double)")) for n, x in _NUMBERS.items()}
    p = [F.round(x, 9) for x in ret.ordered_logit(_MODEL)]
    rows = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), "o_custkey", *[v.alias(n) for n, v in numbers.items()])
    scored = rows.select("case", "o_custkey", F.struct(*[x.alias(n.lower()) for x, n in zip(p, CLASSES, strict=True)]).alias("probabilities"))
    top = F.greatest(*[F.col(f"probabilities.{n.lower()}") for n in CLASSES])
    action = F.when(F.col("probabilities.cut") == top, "CUT").when(F.col("probabilities.hold") == top, "HOLD").otherwise("HIKE")
    return scored.withColumn("logit_action", action)


@query("m05_stored_logit", f"""{_FORE} SELECT "case", round(l, 9) AS cut, round(h - l, 9) AS hold, round(1 - h, 9) AS hike, la AS action FROM ch""")
def m05_stored_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("case", "probabilities.*", F.col("logit_action").alias("action"))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    persisted = scored.select("case", F.when(F.pmod("o_custkey", F.lit(2)) == 0, "CUT").otherwise("HOLD").alias("persistence_action"))
    roster = c.rosters(spark, sf_dir).select(F.col("meeting").alias("case"), F.explode("ids").alias("participant"))
    history = s.member_votes(spark, sf_dir).groupBy("participant").agg(F.avg(F.col("dissent").cast("int")).alias("rate"))
    held = F.when(F.pmod("participant", F.lit(2)) == 0, F.array(F.concat(F.lit("doc-"), F.col("participant").cast("string")))).otherwise(F.array().cast("array<string>"))
    voters = roster.join(history, "participant").select("case", "participant", F.when(F.col("rate") >= 0.35, "AGAINST").otherwise("FOR").alias("baseline_vote"), held.alias("evidence"))
    accuracy = spark.range(1).select(F.lit(0.82).alias("persistence"), F.lit(0.58).alias("logit"))
    return tr.assembled_forecast(persisted, scored.select("case", "logit_action", "probabilities"), accuracy, voters, _combined(spark, sf_dir))


_ASSEMBLED = f"""{_FORE}, rt AS (SELECT participant, avg(dissent::INT) AS rate FROM mv GROUP BY 1), bl AS (SELECT meeting AS "case", list(CASE WHEN rate >= 0.35 THEN 'AGAINST' ELSE 'FOR' END ORDER BY participant) AS base, list(participant ORDER BY participant) AS ids FROM ros JOIN rt USING (participant) GROUP BY 1),
fc AS (SELECT ch."case", CASE WHEN com."case" IS NOT NULL AND problem IS NULL THEN com.action ELSE pa END AS action, CASE WHEN com."case" IS NOT NULL AND problem IS NULL THEN 'ensemble' ELSE 'persistence' END AS model, pa = la AS models_agree,
CASE WHEN com."case" IS NOT NULL AND problem IS NULL THEN com.votes ELSE coalesce(base, []) END AS votes, coalesce(ids, []) AS ids FROM ch LEFT JOIN com ON com."case" = ch."case" LEFT JOIN bl ON bl."case" = ch."case")"""


@query("m13_assembled_forecasts", f'{_ASSEMBLED} SELECT "case", action, model, models_agree, votes FROM fc')
def m13_assembled_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecasts(spark, sf_dir).select("case", "action", "model", "models_agree", F.transform("voters", lambda v: v["vote"]).alias("votes"))


@query("m22_evidence_coverage", f"""{_ASSEMBLED} SELECT "case", len(list_filter(ids, lambda p: p % 2 = 0))::INTEGER AS covered, list_filter(ids, lambda p: p % 2 = 1) AS missing, len(list_filter(votes, lambda v: v = 'AGAINST'))::INTEGER AS against FROM fc""")
def m22_evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.filter("voters", lambda v: F.size(v["evidence"]) == 0)
    return _forecasts(spark, sf_dir).select(
        "case", (F.size("voters") - F.size(bare)).alias("covered"), F.transform(bare, lambda v: v["participant"]).alias("missing"), F.size(F.filter("voters", lambda v: v["vote"] == "AGAINST")).alias("against")
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.member_votes(spark, sf_dir).groupBy("participant").agg(F.count("*").alias("prior_votes"), F.count_if("dissent").alias("prior_dissents"))


@query("b23_explanation_inputs", f"""{_ASSEMBLED}, x AS (SELECT "case", action, unnest(ids) AS participant, unnest(votes) AS vote FROM fc), h AS (SELECT participant, count(*) AS n, count(*) FILTER (dissent) AS d FROM mv GROUP BY 1)
SELECT "case", participant, action, vote, n AS prior_votes, d::DOUBLE / n AS prior_rate, CASE WHEN participant % 2 = 0 THEN 'doc-' || participant END AS document_id, true AS guarded FROM x JOIN h USING (participant)""")
def b23_explanation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tr.explanation_inputs(_forecasts(spark, sf_dir), _history(spark, sf_dir))
    return made.select(
        "case", "participant", F.col("input.meeting.predicted_policy_action").alias("action"), F.col("input.member.predicted_vote").alias("vote"), F.col("input.member.prior_votes").alias("prior_votes"),
        F.col("input.member.prior_dissent_rate").alias("prior_rate"), F.get("input.member.communications", F.lit(0)).alias("document_id"), F.col("input.guardrails.may_not_invent_evidence").alias("guarded"),
    )


@query("m20_variant_matrix", f"""WITH {s.VOTES_SQL}, r AS (SELECT 'v' || meeting % 5 AS variant, meeting, bool_and(NOT dissent) AS hit, count(*) FILTER (dissent) AS e, count(*) FILTER (dissent AND participant % 2 = 0) AS tp, count(*) FILTER (NOT dissent AND participant % 2 = 0) AS fp, count(*) FILTER (dissent AND participant % 2 = 1) AS fn FROM mv GROUP BY 2),
a AS (SELECT variant, count(*) AS n, avg(hit::INT) AS accuracy, avg(e) AS error, coalesce(2.0::DOUBLE * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS f1 FROM r GROUP BY 1)
SELECT variant, 'model' AS kind, n, round(accuracy, 9) AS accuracy, round(error, 9) AS error, round(f1, 9) AS f1, variant <> 'v3' AS agrees FROM a UNION ALL SELECT 'majority', 'deterministic', count(*), round(avg((o_orderstatus = 'O')::INT), 9), round(avg((o_orderstatus <> 'O')::INT), 9), NULL, NULL FROM orders""")
def m20_variant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, d = F.pmod("participant", F.lit(2)) == 0, F.col("dissent")
    reports = s.member_votes(spark, sf_dir).groupBy("meeting").agg(F.bool_and(~d).alias("hit"), F.count_if(d).alias("error"), F.count_if(d & even).alias("tp"), F.count_if(~d & even).alias("fp"), F.count_if(d & ~even).alias("fn"))
    runs = reports.withColumn("variant", F.concat(F.lit("v"), F.pmod("meeting", F.lit(5)).cast("string"))).withColumnRenamed("meeting", "case")
    f1 = F.coalesce(F.try_divide(2.0 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), F.lit(0.0))
    stored = runs.groupBy("variant").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("accuracy"), f1.alias("f1")).withColumn("n", F.when(F.col("variant") == "v3", F.col("n") + 1).otherwise(F.col("n")))
    held = F.col("action") == "HOLD"
    majority = s.outcomes(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(held.cast("int")).alias("accuracy"), F.avg((~held).cast("int")).alias("error")).withColumn("variant", F.lit("majority"))
    made = tr.variant_matrix(majority, runs, stored)
    return made.withColumns({x: F.round(x, 9) for x in ("accuracy", "error", "f1")})


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import newest_before
    from .relational import _documents
    from .temporal import LIMITS

    cuts = s.cutoffs(spark, sf_dir)
    snap = t.snapshot(s.vintages(spark, sf_dir), cuts, LIMITS, 3).filter("series_id <> 'view'").select(F.col("meeting_id").alias("case"), "series_id", "observation_date", "value")
    context = t.rate_context(t.directions(t.change_points(s.daily_levels(spark, sf_dir))), cuts).filter("series_id = 'view'").select(F.col("meeting_id").alias("case"), "ordinal", "kind", "day", "level")
    docs = newest_before(_documents(spark, sf_dir), cuts, 5, [F.col("usage"), F.col("doc_id")]).select(F.col("meeting_id").alias("case"), "rank", "doc_id")
    seats = s.table(spark, sf_dir, "supplier").select(F.pmod("s_suppkey", F.lit(7)).alias("seat"), F.col("s_suppkey").alias("participant"))
    voters = cuts.withColumn("seat", F.pmod(F.weekofyear("cutoff"), F.lit(7))).join(seats, "seat").select(F.col("meeting_id").alias("case"), "participant")
    return tr.case_bundles(cuts.withColumnRenamed("meeting_id", "case"), {"snapshot": snap, "context": context, "documents": docs, "voters": voters})


@query("b01_b06_case_bundles", f"""WITH {s.LEVELS_SQL}, {s.CUTOFFS_SQL}, vis AS (SELECT meeting_id, series_id, observation_date FROM vint JOIN cut ON observation_date <= cutoff AND realtime_start <= cutoff WHERE value IS NOT NULL AND series_id <> 'view' GROUP BY 1, 2, 3),
sn AS (SELECT meeting_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, series_id ORDER BY observation_date DESC) AS rn FROM vis) WHERE rn <= CASE series_id WHEN 'click' THEN 8 ELSE 3 END GROUP BY 1),
chg AS (SELECT day FROM (SELECT *, lag(level) OVER w AS b, row_number() OVER w AS rn FROM lev WHERE series_id = 'view' WINDOW w AS (ORDER BY day)) WHERE rn = 1 OR level IS DISTINCT FROM b),
ct AS (SELECT meeting_id, 1 + least(8, count(*)) AS n FROM chg JOIN cut ON day <= cutoff GROUP BY 1),
dc AS (SELECT meeting_id, list(doc_id ORDER BY rank) AS ids FROM (SELECT meeting_id, doc_id, row_number() OVER (PARTITION BY meeting_id ORDER BY p DESC, u, doc_id) AS rank FROM (SELECT doc_id, DATE '2024-01-01' + (doc_id % 60)::INTEGER AS p, (['INPUT', 'LABEL', 'AUDIT'])[doc_id % 3 + 1] AS u FROM documents) JOIN cut ON p < cutoff) WHERE rank <= 5 GROUP BY 1)
SELECT meeting_id AS "case", coalesce(sn.n, 0)::INTEGER AS n_snapshot, coalesce(ct.n, 0)::INTEGER AS n_context, coalesce(ids, []) AS documents, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = weekofyear(cutoff) % 7)::INTEGER AS n_voters
FROM cut LEFT JOIN sn USING (meeting_id) LEFT JOIN ct USING (meeting_id) LEFT JOIN dc USING (meeting_id)""")
def b01_b06_case_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _bundles(spark, sf_dir)
    sizes = tr.bundle_sizes(made, ["snapshot", "context", "documents", "voters"])
    ids = made.select("case", F.transform("documents", lambda x: x["doc_id"]).alias("documents"))
    return sizes.join(ids, "case").select("case", "n_snapshot", "n_context", "documents", "n_voters")


@query("b05_forward_bundles", f"""{_ASSEMBLED}, x AS (SELECT "case", unnest(ids) AS participant FROM fc), z AS (SELECT "case", count(*) AS n_participants, count(*) FILTER (participant % 2 = 0) AS n_speeches FROM x GROUP BY 1)
SELECT fc."case", coalesce(n_participants, 0)::INTEGER AS n_participants, coalesce(n_participants, 0)::INTEGER AS n_cards, coalesce(n_speeches, 0)::INTEGER AS n_speeches, 64 AS hash_length FROM fc LEFT JOIN z ON z."case" = fc."case" """)
def b05_forward_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts with their voters, a card of each one's history and the speeches that are evidence.

    A forecast is made once: its voters and speeches are arrays of its row, and only cards come by a join, of the members of its roster.
    """
    made = _forecasts(spark, sf_dir)
    newest = s.votes(spark, sf_dir).agg(F.max("meeting")).first()[0]
    cards = t.recency(s.member_votes(spark, sf_dir), newest + 1)
    seats = c.rosters(spark, sf_dir).select(F.col("meeting").alias("case"), F.explode_outer("ids").alias("participant"))
    given = lambda v: F.transform(v["evidence"], lambda d: F.struct(v["participant"].alias("participant"), d.alias("document_id")))
    parts = {
        "participants": F.transform("voters", lambda v: F.struct(v["participant"].alias("participant"), v["vote"].alias("vote"))), "cards": seats.join(cards, "participant").select("case", "participant", *cards.columns[1:]),
        "speeches": F.flatten(F.transform("voters", given)),
    }
    bundles = tr.case_bundles(made.select("case", "action", "models_agree", "voters"), parts, ("voters",))
    return tr.bundle_sizes(bundles, list(parts), F.length("bundle_hash").alias("hash_length")).drop("bytes")


_TAXONOMY = {"PRICES": ["the", "der"], "LABOUR": ["of", "und"], "RATES": ["and", "die"], "GROWTH": ["de", "le"], "RISK": ["la", "que"]}


def _count_sql(col: str, term: str) -> str:
    return f"len(list_filter(string_split_regex(lower({col}), '[^a-z0-9_]+'), lambda w: w = '{term}'))"


@query("f16_salient_topics", "WITH d AS (SELECT source AS participant, doc_id, unnest([" + ", ".join(f"{{'topic': '{n}', 'score': " + " + ".join(f"4 * {_count_sql('split_part(text, chr(10), 1)', w)} + least(8, {_count_sql('text', w)})" for w in ws) + "}" for n, ws in _TAXONOMY.items()) + """]) AS t FROM documents),
r AS (SELECT participant, doc_id, t.topic AS topic, t.score AS score, row_number() OVER (PARTITION BY participant, t.topic ORDER BY t.score DESC, doc_id) AS place FROM d WHERE t.score > 0), g AS (SELECT participant, topic, sum(score)::BIGINT AS score, list(doc_id ORDER BY place) FILTER (place <= 3) AS evidence_ids FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY score DESC, topic)::INTEGER AS rank FROM g) SELECT *, score::DOUBLE / sum(score) OVER (PARTITION BY participant) AS share FROM k WHERE rank <= 3""")
def f16_salient_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as their source's communications; the first line is the title."""
    docs = s.table(spark, sf_dir, "documents").select(F.col("source").alias("participant"), F.col("doc_id").alias("document_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), "text")
    return tr.salient_topics(docs, _TAXONOMY)


@query("p12_context_rules", f"""WITH c AS (SELECT conv_id AS context, turn AS participant, CASE turn WHEN 0 THEN 'chair' WHEN 1 THEN 'vice_chair' WHEN 5 THEN 'guest' ELSE 'member' END AS role FROM conversations), n AS (SELECT context, count(*) AS n, count(DISTINCT participant) AS d, count(*) FILTER (role = 'chair') AS ch, count(*) FILTER (role = 'vice_chair') AS v, count(*) FILTER (role = 'guest') AS g,
count(*) FILTER (participant > 3) AS late, count(*) FILTER (participant > 3 AND participant % 2 = 1) AS strange FROM c GROUP BY 1) SELECT context, {_list_sql({'MEMBERS': 'n <> 4', 'DUPLICATE': 'd < n', 'CHAIR': 'ch <> 1', 'VICE_CHAIR': 'v <> 1', 'ROLE': 'g > 0', 'LATE': 'late > 0', 'STRANGER': 'strange > 0'})} AS broken FROM n""")
def p12_context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as contexts: turns are members, those after turn 3 spoke late, every second of these by someone else."""
    role = F.when(F.col("turn") == 0, "chair").when(F.col("turn") == 1, "vice_chair").when(F.col("turn") == 5, "guest").otherwise("member")
    members = s.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("context"), F.col("turn").alias("participant"), role.alias("role"))
    said = members.select("context", F.when((F.col("participant") > 3) & (F.pmod("participant", F.lit(2)) == 1), -1).otherwise(F.col("participant")).alias("participant"), F.col("participant").alias("published"))
    return tr.context_rules(members, said, members.select("context", F.lit(3).alias("as_of")).distinct(), 4)


@query("b24_prediction_rules", f"""{_OUT}, l AS (SELECT meeting, list(participant ORDER BY participant) AS ids FROM ros GROUP BY 1) SELECT meeting AS "case", {_list_sql({'PROFILES': 'meeting % 4 = 0 AND len(ids) > 0', 'CONTRIBUTIONS': 'meeting % 6 = 0', 'VOTES': 'meeting % 10 = 0', 'CHAIR': 'meeting % 15 = 0', 'PROPOSER': 'meeting % 9 = 0 AND len(ids) > 1', 'EVIDENCE': 'meeting % 21 = 0', 'OPTIONS': 'meeting % 35 = 0'})} AS violations FROM l""")
def b24_prediction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that agree with the roster, with some parts left out, added or changed by their meeting's number."""
    every = lambda n: F.pmod("case", F.lit(n)) == 0
    ids = F.col("ids")
    rows = c.rosters(spark, sf_dir).select(F.col("meeting").alias("case"), "ids")
    records = rows.select(
        "case", ids.alias("roster"), F.when(every(4), F.slice(ids, F.lit(2), F.size(ids))).otherwise(ids).alias("profiles"), F.when(every(6), F.array_append(ids, F.lit(-1))).otherwise(ids).alias("contributions"),
        F.when(every(10), F.array_append(ids, ids[0])).otherwise(ids).alias("votes"), F.when(every(15), F.array(ids[0], ids[0])).otherwise(F.array(ids[0])).alias("chairs"),
        F.when(every(9), F.element_at(ids, -1)).otherwise(ids[0]).alias("proposer"), F.when(every(35), F.array(F.lit("CUT"), F.lit("HOLD"))).otherwise(F.array(*[F.lit(x) for x in CLASSES])).alias("options"),
        F.when(every(21), F.array(F.lit(-5).cast("long"))).otherwise(ids).alias("cited"),
    )
    return tr.prediction_rules(records, rows.select("case", F.explode("ids").alias("evidence_id")), CLASSES)


@query("b19_segments", """WITH cv AS (SELECT conv_id, turn, role, trim(text, ' ') AS body FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) - 1 AS ordinal, count(*) OVER (PARTITION BY conv_id) AS n FROM cv WHERE body <> '')
SELECT conv_id AS document, 'segment-' || conv_id || '-' || ordinal AS segment_id, ordinal::INTEGER AS ordinal, upper(role) AS speaker, CASE upper(role) WHEN 'USER' THEN 1 WHEN 'ASSISTANT' THEN 2 END AS member, sha256(body) AS text_hash, n >= 4 AS accepted FROM o""")
def b19_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = s.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.trim("text").alias("b")).alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: F.concat(F.lit("\n@"), F.upper(x["role"]), F.lit(": "), x["b"])), "")
    people = spark.createDataFrame([(1, "Una User"), (2, "Abe Assistant"), (3, "Sam System"), (4, "Sue System")], "id int, name string")
    return tr.transcript_segments(turns.groupBy(F.col("conv_id").alias("document")).agg(text.alias("text")), people, "\n@([A-Z]+): ", 4)


@query("b22_replay_records", f"{_OUT} SELECT o.meeting, action, coalesce(len(names), 0)::INTEGER AS n_votes, CASE WHEN o.meeting % 3 = 0 AND k IS NOT NULL THEN 'full' ELSE 'base' END AS tier, CASE WHEN o.meeting % 3 = 0 THEN k END::INTEGER AS n_assumptions, 2 AS n_series FROM outc o LEFT JOIN sides s ON s.meeting = o.meeting LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o.meeting")
def b22_replay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third meeting with lines has a trace; the two series are the order's level and priority's number."""
    traces = _traces(spark, sf_dir).filter("key % 3 = 0 and size(assumptions) > 0").select(F.col("key").alias("meeting"), F.col("assumptions.assumption_id").alias("assumptions"))
    o = s.outcomes(spark, sf_dir)
    levels = o.select("meeting", F.array(F.struct("decided_on", "level"), F.struct("decided_on", F.lit(1.0).alias("level"))).alias("series"))
    made = tr.replay_records(o, s.member_votes(spark, sf_dir), traces, levels)
    return made.select("meeting", "action", F.coalesce(F.size("votes"), F.lit(0)).alias("n_votes"), "tier", F.when(F.col("assumptions").isNotNull(), F.size("assumptions")).alias("n_assumptions"), F.size("series").alias("n_series"))
