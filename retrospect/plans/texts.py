"""Queries over text functions, dates, nested values and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as x
from ..sources import tables as s
from .registry import query
from .temporal import EVENTS_SQL, assumption_events

_WS = r"[ \t\n\x0b\f\r]+"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(x.STOP_WORDS))) + "]"
STEM = """CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN w[:-4] WHEN length(w) > 5 AND ends_with(w, 'ed') THEN w[:-3]
WHEN length(w) > 4 AND ends_with(w, 'es') THEN w[:-3] WHEN length(w) > 4 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END"""
TERMS = f"list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)), lambda w: {STEM})"
TAGS = {"HAWK": "der|tion", "DOVE": "queeux|air", "LABOUR": "ment|leau", "RATES": r"\bthe\b"}
CUES = {"tion": 3, "ent": -2, r"\bof\b": 1}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "documents")


@query("f02_cleaned", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(text, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212) || chr(8209) || chr(160), '''''\"\"--- '), '[\u0080-\u009f]', '-', 'g'), '{_WS}', ' ', 'g'))) AS h FROM documents")
def f02_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(x.cleaned(F.col("text")).cast("binary")).alias("h"))


@query("f03_collapsed", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r\u00a0\u00ad]+', ' ', 'g'))) AS h FROM documents")
def f03_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(x.collapsed(F.col("text")).cast("binary")).alias("h"))


@query("f04_terms", f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {TERMS} AS t FROM documents)")
def f04_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", x.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ").cast("binary")).alias("h"))


@query("f05_f06_names", r"SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, list_filter(regexp_extract_all(s_name || ' Jr', '[A-Za-z0-9]+'), lambda w: w NOT IN ('Jr', 'Sr', 'II', 'III', 'IV'))[-1] AS surname FROM supplier")
def f05_f06_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    return s.table(spark, sf_dir, "supplier").select("s_suppkey", x.slug(name).alias("slug"), x.surname(F.concat(name, F.lit(" Jr"))).alias("surname"))


@query("f09_mixed_fraction", "SELECT l_orderkey, l_linenumber, l_quantity + (l_linenumber % 3 + 1) / 4.0::DOUBLE AS number FROM lineitem")
def f09_mixed_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("-"), (F.col("l_linenumber") % 3 + 1).cast("string"), F.lit("/4"))
    return s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.mixed_fraction(token).alias("number"))


@query("f10_tags", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p in TAGS.items()) + "], lambda z: z IS NOT NULL) AS tags FROM documents")
def f10_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", x.tag_labels(F.col("text"), TAGS).alias("tags"))


@query("f12_cue_score", "SELECT conv_id, turn, " + " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w} ELSE 0 END" for p, w in CUES.items()) + " AS score FROM conversations")
def f12_cue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", x.cue_score(F.col("text"), CUES).alias("score"))


@query("f14_excerpt", f"""WITH w AS (SELECT item_id, string_split(trim(regexp_replace(text, '{_WS}', ' ', 'g')), ' ') AS w FROM benchmark),
f AS (SELECT *, greatest(coalesce(least(nullif(coalesce(list_position(list_transform(w, lambda z: lower(z)), 'the'), 0), 0), nullif(coalesce(list_position(list_transform(w, lambda z: lower(z)), 'of'), 0), 0)), 1) - 5, 1) AS i FROM w)
SELECT item_id, CASE WHEN i > 1 THEN '... ' ELSE '' END || array_to_string(w[i:i + 19], ' ') || CASE WHEN i + 20 <= len(w) THEN ' ...' ELSE '' END AS excerpt FROM f""")
def f14_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "benchmark").select("item_id", x.excerpt(F.col("text"), ["the", "of"]).alias("excerpt"))


@query("f15_relevance", r"SELECT doc_id, " + " + ".join(f"4 * len(list_filter(regexp_extract_all(lower(text[1:80]), '[a-z]+'), lambda w: w = '{w}')) + least(5, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w = '{w}')))" for w in ("the", "of")) + " AS score FROM documents")
def f15_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring("text", 1, 80)
    return _docs(spark, sf_dir).select("doc_id", x.relevance(title, F.col("text"), ["the", "of"]).cast("long").alias("score"))




@query("f17_phrase_flags", "SELECT conv_id, turn, regexp_matches(text, '(?i)tion') AS support, regexp_matches(text, '(?i)\\bthe\\b') AS flip FROM conversations")
def f17_phrase_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").rlike("(?i)tion").alias("support"), F.col("text").rlike(r"(?i)\bthe\b").alias("flip"))


@query("f21_token_estimate", "SELECT doc_id, greatest(1, ceil(strlen(text) / 4.0))::BIGINT AS tokens FROM documents")
def f21_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", x.token_estimate(F.col("text")).alias("tokens"))


@query("f22_speaker_segments", """WITH c AS (SELECT conv_id, turn, role, trim(text, ' ') AS body FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) - 1 AS ordinal FROM c WHERE body <> '')
SELECT conv_id, ordinal::INTEGER AS ordinal, upper(role) AS speaker, md5(body) AS h FROM o""")
def f22_speaker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = s.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.trim("text").alias("b")).alias("t"))
    joined = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.concat(F.lit("\n@"), F.upper(t["role"]), F.lit(": "), t["b"])), "").alias("text"))
    parts = joined.select("conv_id", F.posexplode(x.speaker_segments(F.col("text"), "\n@([A-Z]+): ")).alias("ordinal", "p"))
    return parts.select("conv_id", "ordinal", "p.speaker", F.md5(F.col("p.body").cast("binary")).alias("h"))


@query("d02_event_records", f"WITH {s.OUTCOMES_SQL} SELECT DISTINCT 'FOMC-' || decided_on::VARCHAR AS meeting_id, decided_on - 1 AS cutoff FROM outc")
def d02_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("decided_on")
    return s.outcomes(spark, sf_dir).select(F.concat(F.lit("FOMC-"), day.cast("string")).alias("meeting_id"), F.date_sub(day, 1).alias("cutoff")).distinct()


@query("d05_day_lag", "SELECT l_orderkey, l_linenumber, (l_shipdate::DATE - o_orderdate::DATE)::INTEGER AS lag_days, l_shipdate::DATE < o_orderdate::DATE AS negative FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def d05_day_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = s.table(spark, sf_dir, "lineitem").join(s.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lag = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return joined.select("l_orderkey", "l_linenumber", lag.alias("lag_days"), (lag < 0).alias("negative"))


@query("d06_instants", "SELECT event_id, event_id % 2 = 0 AS has_zone, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000000 END AS seconds FROM events")
def d06_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod("event_id", F.lit(2)) == 0, "Z").otherwise(""))
    zoned = text.rlike(r"(Z|[+-]\d\d:\d\d)$")
    seconds = F.when(zoned, F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))
    return s.table(spark, sf_dir, "events").select("event_id", zoned.alias("has_zone"), seconds.alias("seconds"))


@query("d07_d08_probabilities", """WITH z AS (SELECT event_id, (value - 50) / 40 AS v FROM events), p AS (SELECT event_id, 1 / (1 + exp(v + 1)) AS a, 1 / (1 + exp(v - 1)) AS b FROM z), q AS (SELECT event_id, a AS p0, b - a AS p1, 1 - b AS p2 FROM p),
w AS (SELECT *, pow(p0, 0.7) * pow(0.2, 0.3) AS r0, pow(p1, 0.7) * pow(0.6, 0.3) AS r1, pow(p2, 0.7) * pow(0.2, 0.3) AS r2 FROM q)
SELECT event_id, round(r0 / (r0 + r1 + r2), 6) AS cut, round(r1 / (r0 + r1 + r2), 6) AS hold, round(r2 / (r0 + r1 + r2), 6) AS hike FROM w""")
def d07_d08_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = x.logit_probabilities((F.col("value") - 50) / 40, (-1.0, 1.0))
    b = x.blended(p, [F.lit(0.2), F.lit(0.6), F.lit(0.2)], 0.3)
    return s.table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(b, ("cut", "hold", "hike"), strict=True)])


@query("d09_tiered_cost", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > 30000 THEN (greatest(0, l_extendedprice - l_partkey) * 4 + l_partkey * 1) / 1e6 ELSE (greatest(0, l_extendedprice - l_partkey) * 2 + l_partkey * 0.5) / 1e6 END, 8) AS cost FROM lineitem")
def d09_tiered_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = x.tiered_cost(F.col("l_extendedprice"), F.col("l_partkey"), 30000, (2.0, 0.5), (4.0, 1.0))
    return s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(cost, 8).alias("cost"))


@query("d09_usage_cost", """WITH u AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS n, l_partkey AS cached, l_suppkey * 100 AS written, l_quantity AS made, l_extendedprice > 30000 AS long FROM lineitem)
SELECT l_orderkey, l_linenumber, round(((CASE WHEN n > cached + written THEN n - cached - written ELSE 0 END) * CASE WHEN long THEN 4 ELSE 2 END + cached * CASE WHEN long THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + written * CASE WHEN long THEN 5.0::DOUBLE ELSE 2.5::DOUBLE END + made * CASE WHEN long THEN 18 ELSE 12 END) / 1e6, 8) AS cost FROM u""")
def d09_usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, long = {"input": 2.0, "cached_input": 0.5, "cache_write": 2.5, "output": 12.0}, {"input": 4.0, "cached_input": 1.0, "cache_write": 5.0, "output": 18.0}
    cost = x.usage_cost(F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey") * 100, F.col("l_quantity"), 30000, short, long)
    return s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(cost, 8).alias("cost"))


@query("d11_array_ops", f"WITH t AS (SELECT doc_id, {TERMS} AS t FROM documents) SELECT doc_id, len(list_intersect(t, ['tion', 'reth', 'aire', 'ment'])) AS overlap, len(list_distinct(t)) AS n_distinct FROM t")
def d11_array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", x.terms(F.col("text")).alias("t"))
    tags = F.array(*[F.lit(w) for w in ("tion", "reth", "aire", "ment")])
    return t.select("doc_id", F.size(F.array_intersect("t", tags)).alias("overlap"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("d16_event_map", f"WITH {EVENTS_SQL}, l AS (SELECT assumption_id, kind, max(event_id) AS e FROM ev GROUP BY 1, 2) SELECT assumption_id, count(*) AS n_kinds, max(e) FILTER (kind = 'REVIEWED') AS reviewed FROM l GROUP BY 1")
def d16_event_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = assumption_events(spark, sf_dir).groupBy("assumption_id", "kind").agg(F.max("event_id").alias("e"))
    maps = last.groupBy("assumption_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "e"))).alias("m"))
    return maps.select("assumption_id", F.size("m").alias("n_kinds"), F.try_element_at("m", F.lit("REVIEWED")).alias("reviewed"))


@query("d17_quality_flags", "SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'SHORT' END, CASE WHEN contains(text, '!!') THEN 'SHOUTING' END, CASE WHEN lang <> 'en' THEN 'FOREIGN' END], lambda z: z IS NOT NULL) AS flags, n_chars < 200 OR contains(text, '!!') OR lang <> 'en' AS high FROM documents")
def d17_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"SHORT": F.col("n_chars") < 200, "SHOUTING": F.col("text").contains("!!"), "FOREIGN": F.col("lang") != "en"}
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return _docs(spark, sf_dir).select("doc_id", flags.alias("flags")).withColumn("high", F.size("flags") > 0)


_PIECES = r"""WITH t AS (SELECT page_id, string_split(regexp_replace(html, '(?s)<(script|style).*?</(script|style)>', '', 'g'), '<p>') AS s FROM pages),
p AS (SELECT page_id, i, len(s) AS n, s[i] AS piece FROM (SELECT *, unnest(range(2, len(s) + 1)) AS i FROM t)),
c AS (SELECT page_id, i, contains(piece, '</p>') OR i < n AS closed, split_part(piece, '</p>', 1) AS body FROM p)"""


def _plain_sql(body: str) -> str:
    bare = f"regexp_replace({body}, '<[^>]*>', '', 'g')"
    for entity, letter in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{letter}')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


@query("h01_paragraphs", f"""{_PIECES}, x AS (SELECT page_id, i, {_plain_sql("replace(body, '<br>', ' ')")} AS text FROM c WHERE closed)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i)::INTEGER AS ordinal, text FROM x WHERE text <> ''""")
def h01_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.paragraphs(s.table(spark, sf_dir, "pages"))


@query("h02_line_blocks", f"""{_PIECES}, x AS (SELECT page_id, i, list_filter(list_transform(string_split(body, '<br>'), lambda z: {_plain_sql("z")}), lambda z: z <> '') AS lines FROM c)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i)::INTEGER AS ordinal, lines FROM x WHERE len(lines) > 0""")
def h02_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.line_blocks(s.table(spark, sf_dir, "pages"))


@query("h05_links", r"""SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(replace(h, '&amp;', '&'), '^[^?#]*') AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM pages)""")
def h05_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(s.table(spark, sf_dir, "pages"))
