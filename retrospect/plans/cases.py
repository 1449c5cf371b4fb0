"""Queries over case assembly: flips, responses, names, merged evidence, references and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases as c
from ..sources import tables as s
from .registry import query

PATHS = ["context", "options", "debate", "decision", "vote.rounds", "assumptions"]


@query("m16_phrase_flip", r"""WITH x AS (SELECT conv_id AS claim, turn AS tick, turn AS id, regexp_matches(text, '(?i)tion') AS support, regexp_matches(text, '(?i)e') AS flip FROM conversations),
k AS (SELECT claim, min(tick) FILTER (support AND tick <= 1) AS s, min(tick) FILTER (tick >= 1 AND flip AND NOT support) AS f FROM x GROUP BY 1)
SELECT claim, f AS flip_at, f AS flip_id, CASE WHEN f IS NULL THEN 'NO_STATEMENT_FLIP' WHEN s < f THEN 'OBSERVED' ELSE 'NO_SUPPORT_BEFORE' END AS status FROM k""")
def m16_phrase_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = s.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "claim")
    statements = talk.select("claim", F.col("turn").alias("at"), F.col("turn").alias("id"), F.col("text").rlike("(?i)tion").alias("support"), F.col("text").rlike("(?i)e").alias("flip"))
    claims = talk.select("claim").distinct().select("claim", F.lit(0).alias("adopted_at"), F.lit(1).alias("contradiction_at"))
    return c.first_phrase_flip(statements, claims)


@query("m17_first_response", f"""WITH {s.OUTCOMES_SQL}, d AS (SELECT o_custkey AS desk, outc.* FROM outc JOIN orders ON meeting = o_orderkey),
f AS (SELECT desk, min(decided_on) FILTER (action = 'HOLD') AS flip_at FROM d GROUP BY 1 HAVING flip_at IS NOT NULL), g AS (SELECT *, CASE WHEN desk % 2 = 0 THEN 'HAWKISH' ELSE 'DOVISH' END AS direction FROM f),
r AS (SELECT desk, min({{'on': decided_on, 'meeting': meeting}}) AS z FROM g JOIN d USING (desk) WHERE action = CASE direction WHEN 'HAWKISH' THEN 'HIKE' ELSE 'CUT' END AND decided_on >= flip_at GROUP BY 1)
SELECT g.desk, flip_at, direction, z['on'] AS response_at, z.meeting AS response_meeting FROM g LEFT JOIN r USING (desk)""")
def m17_first_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    desks = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting"), F.col("o_custkey").alias("desk"))
    outcomes = s.outcomes(spark, sf_dir).join(desks, "meeting")
    flips = outcomes.filter("action = 'HOLD'").groupBy("desk").agg(F.min("decided_on").alias("flip_at"))
    direction = F.when(F.pmod("desk", F.lit(2)) == 0, "HAWKISH").otherwise("DOVISH")
    return c.first_response(flips.withColumn("direction", direction), outcomes, "desk")


@query("f25_full_names", """WITH n AS (SELECT DISTINCT concat_ws(' ', l_returnflag, nullif(repeat('m', l_linenumber % 3), ''), 'N' || l_orderkey) AS name, 'N' || l_orderkey AS surname, l_returnflag AS given FROM lineitem)
SELECT surname, first(name ORDER BY length(name) DESC, name DESC) AS full_name FROM n GROUP BY 1 HAVING count(DISTINCT given) = 1""")
def f25_full_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = F.nullif(F.expr("repeat('m', l_linenumber % 3)"), F.lit(""))
    last = F.concat(F.lit("N"), F.col("l_orderkey").cast("string"))
    return c.full_names(s.table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", "l_returnflag", middle, last).alias("name")))


@query("m14_merged_evidence", """WITH m AS (SELECT role AS participant, conv_id || '#' || turn AS document_id, turn AS published, length(text) % 7 AS importance FROM conversations),
b AS (SELECT *, published % 2 = 1 AS added FROM m WHERE published % 2 = 0 OR published >= 2) SELECT participant, document_id, published, importance, added, rank FROM (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY importance DESC, published, document_id)::INTEGER AS rank FROM b) WHERE rank <= 5""")
def m14_merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    talk = s.table(spark, sf_dir, "conversations").select(
        F.col("role").alias("participant"), name.alias("document_id"), F.col("turn").alias("published"), F.pmod(F.length("text"), F.lit(7)).cast("long").alias("importance")
    )
    return c.merged_evidence(talk.filter("published % 2 = 0"), talk.filter("published >= 2"))


@query("d13_evidence_references", f"SELECT conv_id, {PATHS}[turn % 6 + 1] AS path, turn AS document_id, role AS locator FROM conversations")
def d13_evidence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces are nested from conversations (a turn is one reference) and flattened again."""
    ref = F.struct(F.col("turn").alias("document_id"), F.col("role").alias("locator"))
    own = lambda i: F.collect_list(F.when(F.pmod("turn", F.lit(6)) == i, ref))
    held = lambda i: F.struct(own(i).alias("evidence_refs"))
    parts = lambda i: F.transform(own(i), lambda r: F.struct(F.array(r).alias("evidence_refs")))
    traces = s.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        held(0).alias("context"), parts(1).alias("options"), parts(2).alias("debate"), held(3).alias("decision"),
        F.struct(parts(4).alias("rounds")).alias("vote"), parts(5).alias("assumptions"),
    )
    return c.evidence_references(traces, "conv_id")


@query("b10_attribution", """WITH k AS (SELECT o_orderkey AS item, o_custkey % 5 AS participant, count(l_suppkey) AS n, count(*) FILTER (l_linenumber % 3 > 0 AND l_suppkey % 5 = o_custkey % 5) AS own,
count(*) FILTER (l_linenumber % 3 > 0 AND l_suppkey % 5 <> o_custkey % 5) AS other FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT item, CASE WHEN own > 0 THEN participant END AS participant, CASE WHEN own > 0 THEN n - other ELSE n END AS kept, own = 0 AS demoted FROM k""")
def b10_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.pmod("o_custkey", F.lit(5)).alias("participant"))
    references = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.pmod("l_suppkey", F.lit(5)).alias("owner"), (F.col("l_linenumber") % 3 > 0).alias("known"))
    return c.repaired_attribution(items, references)


@query("d04_end_of_day", "SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') || 'T23:59:59Z' AS published_at FROM orders")
def d04_end_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates spelled in a link, in a long heading or in a short heading, and read back."""
    form = F.pmod("o_orderkey", F.lit(3))
    day = F.col("o_orderdate")
    url = F.when(form == 0, F.concat(F.lit("/press/"), F.date_format(day, "yyyyMMdd"), F.lit("a.htm"))).otherwise("/press/statement.htm")
    heading = F.when(form == 1, F.date_format(day, "MMMM d, yyyy")).when(form == 2, F.date_format(day, "MMM d, yyyy"))
    return s.table(spark, sf_dir, "orders").select("o_orderkey", c.end_of_day(url, heading).alias("published_at"))


@query("s11_write_once", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'written' WHEN md5(text) = md5(replace(text, 'tiontion', 'tion')) THEN 'unchanged' ELSE 'refused' END AS status FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def s11_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are stored already; all documents are offered, with a phrase changed."""
    docs = s.table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = docs.join(s.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    changed = F.replace("text", F.lit("tiontion"), F.lit("tion"))
    return c.write_once_status(stored.select("doc_id", F.md5(F.col("text").cast("binary")).alias("fingerprint")), docs.select("doc_id", F.md5(changed.cast("binary")).alias("fingerprint")), "doc_id")


@query("p14_spec_rules", """SELECT l_orderkey AS spec, count(*) = count(DISTINCT l_suppkey % 4) AS unique_ids, list_filter(['1', '3'], lambda v: NOT list_contains(list(l_suppkey % 4)::VARCHAR[], v)) AS missing,
coalesce(list_sort(list(DISTINCT l_returnflag)) = ['A', 'N', 'R'], false) AS exact_metrics, count(*) FILTER (l_linenumber = 1 AND (l_linestatus <> 'F' OR l_tax > 0.04)) = 0 AS probes_closed FROM lineitem GROUP BY 1""")
def p14_spec_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("spec"), F.pmod("l_suppkey", F.lit(4)).cast("string").alias("variant_id"), F.col("l_returnflag").alias("metric"),
        (F.col("l_linenumber") == 1).alias("is_probe"), (F.col("l_linestatus") == "F").alias("shows_date"), (F.col("l_tax") > 0.04).alias("shows_more"),
    )
    return c.spec_rules(rows, ["1", "3"], ["A", "N", "R"])
