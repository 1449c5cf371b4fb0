"""Queries over decision records, features and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair
from ..functions import text as x
from ..operators import records as r
from ..operators import temporal as t
from ..sources import tables as s
from .relational import EPISODES
from .registry import query

_V = f"WITH {s.VOTES_SQL}"
_SENT = r"string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1))"


@query("f07_sentences", f"SELECT doc_id, len(z) AS n, md5(array_to_string(z, chr(10))) AS h FROM (SELECT doc_id, {_SENT} AS z FROM documents)")
def f07_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = s.table(spark, sf_dir, "documents").select("doc_id", r.sentences(F.col("text")).alias("z"))
    return z.select("doc_id", F.size("z").alias("n"), F.md5(F.array_join("z", "\n").cast("binary")).alias("h"))


#: Claims in which a number takes the place of #; SQL knows by their place which faults they have.
_CLAIMS = [
    "Inflation will exceed #", "Growth stays between # and 9 percent", "Unemployment at #% to 40%", "Spending moves symmetrically near its  target of #",
    "Yields rise, provided that oil stays below #", "Job losses with CPI above #", "Rates peak near #, then fall", "Output continues to improve past #",
    "Output stays above #",
]
_SERIES = ["CPIAUCSL", "UNRATE", "T10YIE", "HOUST", "GONE"]


@query("f18_lint", """WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 9 AS c, ['CPIAUCSL', 'UNRATE', 'T10YIE', 'HOUST', 'GONE'][(conv_id % 5) + 1] AS s, turn % 2 = 0 AS yoy, conv_id % 3 <> 0 AS above, turn % 3 - 1 AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN s = 'GONE' THEN ['monitor_series_metadata_is_missing'] ELSE list_filter([
CASE WHEN s = 'CPIAUCSL' AND NOT yoy THEN 'index_percent_threshold_requires_yoy_transform' END, CASE WHEN s = 'HOUST' AND above AND x <= 0 THEN 'nonnegative_level_threshold_is_tautological' END,
CASE WHEN c IN (1, 2, 3) THEN 'range_or_symmetric_claim_requires_atomic_rewrite' END,
CASE WHEN c = 4 OR (s = 'UNRATE' AND c IN (0, 5)) OR (s IN ('CPIAUCSL', 'T10YIE') AND c IN (2, 5)) THEN 'compound_claim_requires_atomic_rewrite' END,
CASE WHEN c IN (6, 7) THEN 'temporal_path_requires_atomic_rewrite' END], lambda z: z IS NOT NULL) END AS faults FROM c""")
def f18_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims spelled out for every turn, of a series of its conversation."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    own = lambda name, n: F.pmod(name, F.lit(n))
    claim = F.replace(pick(_CLAIMS, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9))), F.lit("#"), F.col("turn").cast("string"))
    rows = s.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", pick(_SERIES, own("conv_id", 5)).alias("monitor_series_id"), claim.alias("claim"),
        F.when(own("conv_id", 3) == 0, "LT").when(own("conv_id", 3) == 1, "gte").otherwise("GT").alias("monitor_operator"),
        (own("turn", 3) - 1).cast("double").alias("threshold_value"), F.when(own("turn", 2) == 0, "YoY_v1").otherwise("level_v1").alias("monitor_rule_version"),
    )
    units = {"CPIAUCSL": "Index 1982-1984=100", "UNRATE": "Percent", "T10YIE": "Percent", "HOUST": " Thousands of Units"}
    series = spark.createDataFrame(list(units.items()), "series_id string, units string")
    return r.linted(rows, series).select("conv_id", "turn", "faults")


@query("d01_date_ranges", f"WITH {s.OUTCOMES_SQL} SELECT DISTINCT decided_on AS start_day, decided_on + 1 AS end_day FROM outc")
def d01_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("decided_on")
    spelled = s.outcomes(spark, sf_dir).select(
        F.year(day).alias("y"), F.concat_ws("/", F.date_format(day, "MMMM"), F.date_format(F.date_add(day, 1), "MMMM")).alias("months"),
        F.concat_ws("-", F.dayofmonth(day).cast("string"), F.dayofmonth(F.date_add(day, 1)).cast("string")).alias("days"),
    ).distinct()
    part = lambda c, sep, i: F.element_at(F.split(c, sep), i)
    parse = lambda y, i: F.to_date(F.concat_ws(" ", y.cast("string"), part("months", "/", i), part("days", "-", i)), "yyyy MMMM d")
    start = parse(F.col("y"), 1)
    same_year = parse(F.col("y"), 2)
    return spelled.select(start.alias("start_day"), F.when(same_year < start, parse(F.col("y") + 1, 2)).otherwise(same_year).alias("end_day"))


@query("d10_dissent_probability", f"{_V} SELECT participant, round(least(greatest(avg(dissent::INT) * exp(1.2 * (participant % 3 - 1) * 0.5) * (1 + count(*) / 1000.0), 0.01), 0.9), 9) AS p FROM mv GROUP BY 1")
def d10_dissent_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, n = F.avg(F.col("dissent").cast("int")), F.count("*")
    lean = F.pmod("participant", F.lit(3)) - 1
    stats = s.member_votes(spark, sf_dir).groupBy("participant").agg(base.alias("b"), n.alias("n"))
    p = F.col("b") * F.exp(1.2 * lean * 0.5) * (1 + F.col("n") / 1000.0)
    return stats.select("participant", F.round(F.least(F.greatest(p, F.lit(0.01)), F.lit(0.9)), 9).alias("p"))


@query("j19_b07_locators", "SELECT doc_id, 'paragraph ' || (doc_id % 4 + 1) AS locator, coalesce(contains(string_split(text, chr(10))[doc_id % 4 + 1], 'tion'), false) AS found FROM documents")
def j19_b07_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = s.table(spark, sf_dir, "documents")
    number = (F.pmod("doc_id", F.lit(4)) + 1).cast("string")
    references = docs.select("doc_id", F.concat(F.lit("paragraph "), number).alias("locator"), F.lit("tion").alias("excerpt"))
    return r.located(references, docs).select("doc_id", "locator", "found")


@query("o05_evidence_quota", "SELECT role, rank, locator FROM (SELECT role, conv_id || '#' || turn AS locator, row_number() OVER (PARTITION BY role ORDER BY turn DESC, conv_id DESC, conv_id || '#' || turn DESC)::INTEGER AS rank FROM (SELECT DISTINCT role, conv_id, turn FROM conversations)) WHERE rank <= 2")
def o05_evidence_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import top_per_group

    rows = s.table(spark, sf_dir, "conversations").select("role", "conv_id", "turn").distinct()
    named = rows.withColumn("locator", F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return top_per_group(named, ["role"], [F.col(c).desc() for c in ("turn", "conv_id", "locator")], 2).select("role", "rank", "locator")


_ASOF = f"""WITH {s.VINTAGES_SQL}, {s.CUTOFFS_SQL}, vis AS (SELECT meeting_id, cutoff, series_id, observation_date, arg_max(value, realtime_start) AS value FROM vint JOIN cut ON observation_date <= cutoff AND realtime_start <= cutoff WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4),
l AS (SELECT meeting_id, series_id, max(observation_date) AS d, arg_max(value, observation_date) AS value FROM vis GROUP BY 1, 2),
c AS (SELECT l.meeting_id, l.series_id, l.value, l.value - p.value AS change FROM l LEFT JOIN vis p ON p.meeting_id = l.meeting_id AND p.series_id = l.series_id AND p.observation_date = l.d - 3)"""


@query("m12_member_forecast", f"{_V}, h AS (SELECT participant, avg(dissent::INT) AS rate FROM mv WHERE meeting < (SELECT max(meeting) FROM mv) GROUP BY 1) SELECT s_suppkey AS participant, rate, CASE WHEN rate >= 0.35 THEN 'AGAINST' ELSE 'FOR' END AS vote FROM supplier LEFT JOIN h ON participant = s_suppkey")
def m12_member_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = s.member_votes(spark, sf_dir)
    newest = votes.agg(F.max("meeting")).first()[0]
    history = votes.filter(F.col("meeting") < newest).groupBy("participant").agg(F.avg(F.col("dissent").cast("int")).alias("rate"))
    roster = s.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("participant"))
    return roster.join(history, "participant", "left").withColumn("vote", F.when(F.col("rate") >= 0.35, "AGAINST").otherwise("FOR"))


@query("m19_censoring_audit", f"WITH {s.OUTCOMES_SQL} SELECT action, count(*) FILTER (c) AS constrained, count(*) FILTER (NOT c) AS observed FROM (SELECT action, decided_on BETWEEN DATE '1993-03-01' AND DATE '1994-06-30' OR decided_on BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AS c FROM outc) GROUP BY 1")
def m19_censoring_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import inside_any

    flagged = inside_any(s.outcomes(spark, sf_dir), "decided_on", EPISODES)
    return flagged.groupBy("action").agg(F.count_if("constrained").alias("constrained"), F.count_if(~F.col("constrained")).alias("observed"))


@query("b03_b04_variants", f"WITH {s.OUTCOMES_SQL} SELECT meeting, v AS variant, CASE WHEN v <> 'naked' THEN action END AS action, CASE WHEN v = 'full' THEN level END AS level FROM outc, (VALUES ('full'), ('named'), ('naked')) n(v)")
def b03_b04_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.variants(s.outcomes(spark, sf_dir).select("meeting", "action", "level"), {"full": [], "named": ["level"], "naked": ["action", "level"]})


@query("b06_bundle_sizes", "SELECT source, count(*) AS n_documents, sum(strlen(text))::BIGINT AS n_bytes, sum(greatest(1, ceil(strlen(text) / 4.0)))::BIGINT AS n_tokens FROM documents GROUP BY 1")
def b06_bundle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = s.table(spark, sf_dir, "documents").groupBy("source")
    return grouped.agg(F.count("*").alias("n_documents"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(x.token_estimate(F.col("text"))).alias("n_tokens"))


@query("b09_shredded", f"{_V} SELECT meeting, meeting || '::' || participant AS assumption_id, bool_or(dissent) AS flagged FROM votes GROUP BY meeting, participant")
def b09_shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct("participant", "dissent")
    traces = s.member_votes(spark, sf_dir).groupBy("meeting").agg(F.collect_list(entry).alias("assumptions"))
    rows = traces.select("meeting", F.explode("assumptions").alias("a"))
    return rows.select("meeting", F.concat_ws("::", F.col("meeting").cast("string"), F.col("a.participant").cast("string")).alias("assumption_id"), F.col("a.dissent").alias("flagged"))


@query("b02_b18_completeness", "SELECT source, list(DISTINCT lang ORDER BY lang) AS present, list_filter(['de', 'en', 'es', 'it'], lambda z: NOT list_contains(list(DISTINCT lang), z)) AS missing FROM documents GROUP BY 1")
def b02_b18_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.completeness(s.table(spark, sf_dir, "documents"), "source", "lang", ["en", "de", "es", "it"])


@query("b15_merged_aliases", f"{_V} SELECT meeting, participant - participant % 2 AS member, bool_or(dissent) AS dissent, count(DISTINCT dissent) > 1 AS conflict FROM mv GROUP BY 1, 2")
def b15_merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = s.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("alias")).filter("alias % 2 = 1")
    return r.merged_aliases(s.member_votes(spark, sf_dir), odd.withColumn("canonical", F.col("alias") - 1))


@query("b16_reconciled", f"{_V}, z AS (SELECT meeting, CASE WHEN round % 2 = 0 THEN 'minutes' ELSE 'statement' END AS source, participant % 3 AS member FROM votes), g AS (SELECT meeting, source, string_agg(DISTINCT member::VARCHAR, ',' ORDER BY member::VARCHAR) AS sig FROM z GROUP BY 1, 2) SELECT meeting, count(*) AS n_sources, count(DISTINCT sig) = 1 AS agree FROM g GROUP BY 1")
def b16_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("round") % 2 == 0, "minutes").otherwise("statement")
    return r.reconciled(s.votes(spark, sf_dir).select("meeting", source.alias("source"), F.pmod("participant", F.lit(3)).cast("string").alias("member")))


@query("b20_readiness", f"WITH {s.VINTAGES_SQL}, {s.CUTOFFS_SQL} SELECT 'n_series' AS metric, count(DISTINCT series_id) AS actual, 5::BIGINT AS expected, count(DISTINCT series_id) = 5 AS ready FROM vint UNION ALL SELECT 'n_negative', count(*) FILTER (realtime_end < realtime_start), 0, count(*) FILTER (realtime_end < realtime_start) = 0 FROM vint")
def b20_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = s.vintages(spark, sf_dir)
    metrics = v.agg(F.count_distinct("series_id").alias("n_series"), F.count_if(F.col("realtime_end") < F.col("realtime_start")).alias("n_negative"))
    return r.readiness(metrics, {"n_series": 5, "n_negative": 0})


@query("r13_label_agreement", f"WITH {s.OUTCOMES_SQL} SELECT CASE WHEN meeting % 6 = 0 THEN 'MISSING' WHEN action = 'HOLD' THEN 'MATCH' ELSE 'MISMATCH' END AS status, count(*) AS n FROM outc GROUP BY 1")
def r13_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.outcomes(spark, sf_dir).select("meeting", "action")
    labels = o.filter("meeting % 6 <> 0").select("meeting", F.lit("HOLD").alias("label"))
    status = F.when(F.col("label").isNull(), "MISSING").when(F.col("label") == F.col("action"), "MATCH").otherwise("MISMATCH")
    return o.join(labels, "meeting", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
