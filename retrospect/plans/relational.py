"""Queries over sources, constraints, joins, aggregates, sets and rankings."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hash_tree as ht
from ..operators import relational as r
from ..sources import changes as c
from ..sources import landing as la
from ..sources import tables as s
from ..sources.scratch import scratch_dir
from ..sources.versioned import VersionedTable
from .registry import query

_V = f"WITH {s.VOTES_SQL}"
SECRETS = {"aws": "AKIA[0-9A-Z]{16}", "key": r"sk-[A-Za-z0-9]{20,}", "token": r"gh[pousr]_[A-Za-z0-9]{20,}", "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "google": r"AIza[0-9A-Za-z_\-]{35}"}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = F.element_at(F.array(F.lit("INPUT"), F.lit("LABEL"), F.lit("AUDIT")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    published = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int"))
    return s.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", usage.alias("usage"), published.alias("published"))


_DOCS = """docs AS (SELECT doc_id, source, lang, text, (['INPUT', 'LABEL', 'AUDIT'])[(doc_id % 3) + 1] AS usage, DATE '2024-01-01' + (doc_id % 60)::INTEGER AS published FROM documents)"""


@query("s01_folded_corpus", """WITH x AS (SELECT source AS date, CASE doc_id % 2 WHEN 0 THEN 'Statement' ELSE 'Minute' END AS kind, md5(text) AS text, doc_id FROM documents)
SELECT date, arg_max(text, doc_id) FILTER (kind = 'Statement') AS "Statement", arg_max(text, doc_id) FILTER (kind = 'Minute') AS "Minute" FROM x GROUP BY 1""")
def s01_folded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.pmod("doc_id", F.lit(2)) == 0, "Statement").otherwise("Minute")
    return c.folded_corpus(s.table(spark, sf_dir, "documents").select(F.col("source").alias("date"), kind.alias("kind"), F.md5("text").alias("text"), F.col("doc_id").alias("ordinal")))


@query("s03_s04_parsed_feed", """SELECT event_type AS series_id, ts::DATE AS date, CASE WHEN event_id % 7 = 0 THEN '.' ELSE value::VARCHAR END AS value_raw,
CASE WHEN event_id % 7 <> 0 THEN value END AS value, ts::DATE + (event_id % 3)::INTEGER * CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS realtime_start,
DATE '9999-12-31' AS realtime_end, CASE WHEN event_id % 3 = 0 THEN 'OBSERVATION_DATE_PROXY' ELSE 'VINTAGE' END AS mode FROM events""")
def s03_s04_parsed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    raw = F.when(F.pmod("event_id", F.lit(7)) == 0, ".").otherwise(F.col("value").cast("string"))
    start = F.when(F.pmod("event_id", F.lit(3)) != 0, F.date_add(day, F.pmod("event_id", F.lit(3)).cast("int")))
    return c.parsed_feed(s.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), day.alias("date"), raw.alias("value_raw"), start.alias("realtime_start"), F.lit(None).cast("date").alias("realtime_end")))


def _landed_corpus(spark: SparkSession, sf_dir: str) -> la.Split:
    """Documents as CSV files: quotes over lines, bytes that are no UTF-8, and files that lack a column."""
    docs = s.table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(F.lit("Statement"), F.lit("Minute"), F.lit("Memo")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    number = F.col("doc_id").cast("string")
    text = F.concat(F.lit('"'), number, F.lit('",\n'), F.regexp_replace("text", r"[^\x00-\x7F]", "\u00e9"), F.when(F.pmod("doc_id", F.lit(7)) == 0, "\u00e9").otherwise(""))
    rows = docs.select(F.when(F.pmod("doc_id", F.lit(17)) != 0, F.col("source")).alias("Date"), F.lit("2024-01-01").alias("Release Date"), kind.alias("Type"), text.alias("Text"), "doc_id")
    written = {"header": True, "escape": '"', "encoding": "ISO-8859-1", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    base = f"{scratch_dir(spark)}/landed-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")  # files in the order of ids
    dealt.drop("doc_id").write.options(**written).csv(f"{base}/a")
    rows.filter("doc_id % 11 = 0").select("Date", "Release Date", "Type").write.options(**written).csv(f"{base}/b")
    return la.landed_corpus(spark, base)


_LANDED = """x AS (SELECT source AS date, ['Statement', 'Minute', 'Memo'][(doc_id % 3) + 1] AS kind, doc_id,
'"' || doc_id || '",' || chr(10) || regexp_replace(text, '[^\\x00-\\x7F]', chr(65533), 'g') || CASE WHEN doc_id % 7 = 0 THEN chr(65533) ELSE '' END AS text FROM documents)"""


@query("s01_landed_corpus", f"""WITH {_LANDED} SELECT date, md5(arg_max(text, doc_id) FILTER (kind = 'Statement')) AS "Statement", md5(arg_max(text, doc_id) FILTER (kind = 'Minute')) AS "Minute"
FROM x WHERE doc_id % 17 <> 0 AND date IS NOT NULL AND kind <> 'Memo' GROUP BY 1""")
def s01_landed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = _landed_corpus(spark, sf_dir)
    folded = c.folded_corpus(accepted.withColumn("ordinal", F.struct("file", "position")))
    return folded.select("date", *[F.md5(k).alias(k) for k in la.KINDS])


@query("s01_rejects", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 17 = 0 OR source IS NULL THEN 'NO_DATE' WHEN doc_id % 3 = 2 THEN 'KIND' END AS reason FROM documents
UNION ALL SELECT 'COLUMNS' FROM documents WHERE doc_id % 11 = 0) WHERE reason IS NOT NULL GROUP BY 1""")
def s01_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = _landed_corpus(spark, sf_dir)
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


def _landed_feed(spark: SparkSession, sf_dir: str) -> la.Split:
    """Events as JSON lines; some values are ".", some lines were cut off, some lack their date."""
    day = F.to_date("ts")
    own = lambda n: F.pmod("event_id", F.lit(n))
    line = F.to_json(F.struct(
        F.col("event_type").alias("series_id"), F.when(own(19) != 0, day).alias("date"), F.when(own(7) == 0, ".").otherwise(F.col("event_id").cast("string")).alias("value"),
        F.when(own(3) != 0, F.date_add(day, own(3).cast("int"))).alias("realtime_start"),
    ))
    cut = F.when(own(13) == 0, F.left(line, F.lit(20))).otherwise(line)
    path = f"{scratch_dir(spark)}/feed-{uuid.uuid4().hex}"
    s.table(spark, sf_dir, "events").select(cut.alias("line")).write.text(path)
    return la.landed_feed(spark, path)


@query("s03_landed_feed", """SELECT event_type AS series_id, ts::DATE AS date, CASE WHEN event_id % 7 = 0 THEN '.' ELSE event_id::VARCHAR END AS value_raw, CASE WHEN event_id % 7 <> 0 THEN event_id::DOUBLE END AS value,
ts::DATE + (event_id % 3)::INTEGER AS realtime_start, DATE '9999-12-31' AS realtime_end, CASE WHEN event_id % 3 = 0 THEN 'OBSERVATION_DATE_PROXY' ELSE 'VINTAGE' END AS mode FROM events WHERE event_id % 13 <> 0 AND event_id % 19 <> 0""")
def s03_landed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.parsed_feed(_landed_feed(spark, sf_dir)[0])


@query("s03_rejects", "SELECT CASE WHEN event_id % 13 = 0 THEN 'PARSE' ELSE 'NO_KEY' END AS reason, count(*) AS n FROM events WHERE event_id % 13 = 0 OR event_id % 19 = 0 GROUP BY 1")
def s03_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _landed_feed(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("s05_chunk_merge", "SELECT event_type AS series_id, ts::DATE AS date, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def s05_chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"), "value", "event_id")
    chunks = rows.filter("event_id % 2 = 0").unionByName(rows)
    return c.keep_last(chunks, ["series_id", "date"], F.col("event_id"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = s.outcomes(spark, sf_dir)
    batch = o.filter("meeting % 4 = 0").withColumn("level", F.when(F.pmod("meeting", F.lit(8)) == 0, F.col("level") + 1).otherwise(F.col("level")))
    return o.filter("meeting % 3 <> 0"), batch


_STORED = f"""WITH {s.OUTCOMES_SQL}, old AS (SELECT * FROM outc WHERE meeting % 3 <> 0),
new AS (SELECT meeting, decided_on, action, CASE WHEN meeting % 8 = 0 THEN level + 1 ELSE level END AS level FROM outc WHERE meeting % 4 = 0)"""


def _sink(spark: SparkSession, rows: DataFrame, slice_column: str | None = None) -> VersionedTable:
    """A table in the shared folder that holds `rows` as its version 1."""
    table = VersionedTable.create(spark, f"{scratch_dir(spark)}/outcomes-{uuid.uuid4().hex}", rows.schema, ["meeting"], buckets=16, slice_column=slice_column)
    table.replace_slices(rows) if slice_column else table.insert(rows)
    return table


@query("s08_upsert", f"{_STORED} SELECT * FROM new UNION ALL SELECT * FROM old WHERE meeting NOT IN (SELECT meeting FROM new)")
def s08_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    table = _sink(spark, old)
    table.upsert(new)
    return table.read()


@query("s08_versions", f"""{_STORED} SELECT 1 AS version, * FROM old UNION ALL SELECT 2, * FROM new UNION ALL SELECT 2, * FROM old WHERE meeting NOT IN (SELECT meeting FROM new)""")
def s08_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions after an upsert that came twice: the ledger knows the second time."""
    old, new = _stored(spark, sf_dir)
    table = _sink(spark, old)
    for _ in range(2):
        table.upsert(new, batch_of=("feed", 7))
    return reduce(DataFrame.unionByName, [table.read(v).withColumn("version", F.lit(v)) for v in table.versions()[1:]])


@query("s09_insert_or_ignore", f"{_STORED} SELECT * FROM new WHERE meeting NOT IN (SELECT meeting FROM old)")
def s09_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a commit appended, of a batch without the keys that are stored with other values."""
    old, new = _stored(spark, sf_dir)
    table = _sink(spark, old)
    version = table.insert(new.join(c.conflicts(table.read(), new, ["meeting"]), "meeting", "left_anti"))
    return table.added(version)


@query("s09_conflicts", f"{_STORED} SELECT meeting FROM old JOIN new USING (meeting) WHERE old.level IS DISTINCT FROM new.level")
def s09_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    return c.conflicts(_sink(spark, old).read(), new, ["meeting"])


@query("s10_rebuilt_slice", f"{_STORED} SELECT * FROM old WHERE action <> 'CUT' UNION ALL SELECT * FROM new WHERE action = 'CUT'")
def s10_rebuilt_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    table = _sink(spark, old, slice_column="action")
    table.replace_slices(new.filter("action = 'CUT'"))
    return table.read()


@query("s13_schema_evolution", f"{_STORED} SELECT meeting, decided_on, action, level, 'VINTAGE' AS mode FROM old UNION ALL SELECT *, 'PROXY' FROM new")
def s13_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stored(spark, sf_dir)
    return c.widened(old, new.withColumn("mode", F.lit("PROXY")), {"mode": "VINTAGE"})


@query("s14_incremental_load", "SELECT event_type AS series_id, count(*) AS n FROM events WHERE event_type NOT IN (SELECT event_type FROM events WHERE event_id % 2 = 0 AND event_type < 'm') GROUP BY 1")
def s14_incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "events").withColumnRenamed("event_type", "series_id")
    loaded = rows.filter("event_id % 2 = 0 and series_id < 'm'").select("series_id").distinct()
    return c.missing_rows(loaded, rows, ["series_id"]).groupBy("series_id").agg(F.count("*").alias("n"))


@query("s15_registered", """WITH h AS (SELECT doc_id, source, sha256(text) AS content_hash FROM documents)
SELECT doc_id, source, content_hash, n_sources, 'doc-' || content_hash[1:24] AS document_id FROM h JOIN (SELECT content_hash, count(DISTINCT source) AS n_sources FROM h GROUP BY 1) USING (content_hash)""")
def s15_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.registered(s.table(spark, sf_dir, "documents")).select("doc_id", "source", "content_hash", "n_sources", "document_id")


def _spelled(*columns: str) -> str:
    """A row's fingerprint in SQL."""
    return "sha256(" + " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns) + ")"


@query("d15_manifest", f"""WITH {s.OUTCOMES_SQL}, e AS (SELECT action, {_spelled('meeting', 'decided_on', 'action')} AS f, count(*) AS n FROM outc GROUP BY ALL),
b AS (SELECT action, f[1:4] AS p, sum(n) AS n, sha256(string_agg(f || '*' || n, '|' ORDER BY f)) AS h FROM e GROUP BY 1, 2),
m AS (SELECT action, p[1:2] AS p, sum(n) AS n, sha256(string_agg(p || ':' || h, '|' ORDER BY p)) AS h FROM b GROUP BY 1, 2)
SELECT action, sum(n)::BIGINT AS n_rows, sha256(string_agg(p || ':' || h, '|' ORDER BY p)) AS root FROM m GROUP BY 1""")
def d15_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root over each action's rows, by 65,536 buckets."""
    return ht.roots(s.outcomes(spark, sf_dir), ["meeting", "decided_on", "action"], "action", levels=2)


@query("p02_document_manifest", f"""WITH {_DOCS} SELECT source, count(*) FILTER (usage NOT IN ('INPUT', 'AUDIT')) AS n_usage,
count(*) FILTER (usage IN ('INPUT', 'AUDIT') AND published > DATE '2024-02-01') AS n_late, count(*) FILTER (usage IN ('INPUT', 'AUDIT') AND published <= DATE '2024-02-01') AS n_kept FROM docs GROUP BY 1""")
def p02_document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = r.manifest_filter(_documents(spark, sf_dir), F.lit("2024-02-01").cast("date"), ["INPUT", "AUDIT"])
    why = F.col("excluded")
    return judged.groupBy("source").agg(F.count_if(why == "USAGE").alias("n_usage"), F.count_if(why == "LATE").alias("n_late"), F.count_if(why.isNull()).alias("n_kept"))


@query("p04_year_filter", f"WITH {s.OUTCOMES_SQL} SELECT year(decided_on)::INTEGER AS y, count(*) AS n FROM outc WHERE year(decided_on) BETWEEN 1993 AND 1997 AND action IN ('CUT', 'HIKE') GROUP BY 1")
def p04_year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.outcomes(spark, sf_dir)
    return o.filter(F.year("decided_on").between(1993, 1997) & F.col("action").isin("CUT", "HIKE")).groupBy(F.year("decided_on").alias("y")).agg(F.count("*").alias("n"))


@query("p05_action_class", """SELECT l_orderkey AS meeting, l_linenumber AS round, CASE WHEN l_discount - l_tax > 1e-9 THEN 'HIKE' WHEN l_discount - l_tax < -1e-9 THEN 'CUT' ELSE 'HOLD' END AS action FROM lineitem""")
def p05_action_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.col("l_discount") - F.col("l_tax")
    action = F.when(delta > 1e-9, "HIKE").when(delta < -1e-9, "CUT").otherwise("HOLD")
    return s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting"), F.col("l_linenumber").alias("round"), action.alias("action"))


@query("p06_case_order", f"""WITH {_DOCS} SELECT source, list(usage ORDER BY CASE usage WHEN 'LABEL' THEN 0 WHEN 'INPUT' THEN 1 ELSE 2 END, doc_id)[1:5] AS first_five FROM docs GROUP BY 1""")
def p06_case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("usage") == "LABEL", 0).when(F.col("usage") == "INPUT", 1).otherwise(2)
    top = r.top_per_group(_documents(spark, sf_dir), ["source"], [rank, F.col("doc_id")], 5)
    return top.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "usage"))), lambda x: x["usage"]).alias("first_five"))


@query("p07_violations", """SELECT 'QUANTITY_RANGE' AS rule, l_orderkey AS key FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 49 UNION ALL
SELECT 'FLAG_DOMAIN', l_orderkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'DISCOUNT_OVER_TAX', l_orderkey FROM lineitem WHERE NOT l_discount >= l_tax""")
def p07_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"QUANTITY_RANGE": F.col("l_quantity").between(1, 49), "FLAG_DOMAIN": F.col("l_returnflag").isin("A", "N"), "DISCOUNT_OVER_TAX": F.col("l_discount") >= F.col("l_tax")}
    return r.violations(s.table(spark, sf_dir, "lineitem"), "l_orderkey", rules)


@query("p08_key_audit", f"""{_V} SELECT 'DUPLICATE_KEY' AS problem, count(*) AS n FROM (SELECT 1 FROM votes GROUP BY meeting, participant HAVING count(*) > 1)
UNION ALL SELECT 'ORPHAN', count(*) FROM votes WHERE participant NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)""")
def p08_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = s.table(spark, sf_dir, "supplier").filter("s_nationkey < 20")
    return r.key_audit(s.votes(spark, sf_dir), ["meeting", "participant"], people, "participant", "s_suppkey")


EPISODES = [("1993-03-01", "1994-06-30"), ("1996-01-01", "1996-12-31")]


@query("p09_constrained", f"WITH {s.OUTCOMES_SQL} SELECT meeting, decided_on BETWEEN DATE '1993-03-01' AND DATE '1994-06-30' OR decided_on BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AS constrained FROM outc")
def p09_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.inside_any(s.outcomes(spark, sf_dir), "decided_on", EPISODES).select("meeting", "constrained")


@query("p10_interval_faults", """WITH e AS (SELECT o_orderpriority AS name, min(o_orderdate)::DATE AS start, max(o_orderdate)::DATE AS "end" FROM orders GROUP BY 1)
SELECT * FROM (SELECT *, lag("end") OVER (ORDER BY start, "end", name) AS previous_end FROM e) WHERE start <= previous_end OR "end" < start""")
def p10_interval_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    spec = s.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.min(day).alias("start"), F.max(day).alias("end"))
    return r.interval_faults(spec)


@query("p11_official_host", r"""SELECT page_id, h = 'example.org' OR h = 'example.net' OR ends_with(h, '.example.org') OR ends_with(h, '.example.net') AS official
FROM (SELECT page_id, lower(regexp_extract(url, '^https://([^/?#:]+)', 1)) AS h FROM pages)""")
def p11_official_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "pages").select("page_id", r.official_host(F.col("url"), ["example.org", "example.net"]).alias("official"))


@query("p13_secret_patterns", "SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in SECRETS.items()) + "], lambda x: x IS NOT NULL) AS hits FROM documents")
def p13_secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "documents").select("doc_id", r.pattern_hits(F.col("text"), SECRETS).alias("hits"))


@query("p15_as_of_cap", f"WITH {s.OUTCOMES_SQL} SELECT meeting, least(decided_on - 1, DATE '1996-06-30') AS as_of FROM outc")
def p15_as_of_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.outcomes(spark, sf_dir).select("meeting", F.least(F.date_sub("decided_on", 1), F.lit("1996-06-30").cast("date")).alias("as_of"))


@query("j02_star_view", "SELECT r_name, n_name, count(*) AS n_votes, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def j02_star_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: s.table(spark, sf_dir, name)
    star = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    star = star.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return star.groupBy("r_name", "n_name").agg(F.count("*").alias("n_votes"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("j03_votes_to_outcome", f"{_V}, {s.OUTCOMES_SQL} SELECT mv.*, action FROM mv LEFT JOIN (SELECT * FROM outc WHERE meeting % 5 <> 0) o USING (meeting)")
def j03_votes_to_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = s.outcomes(spark, sf_dir).filter("meeting % 5 <> 0").select("meeting", "action")
    return s.member_votes(spark, sf_dir).join(known, "meeting", "left")


@query("j04_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j04_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return s.table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@query("j05_target_coverage", "SELECT t AS event_type, count(event_id) AS n FROM (VALUES ('view'), ('click'), ('absent')) v(t) LEFT JOIN events ON event_type = t GROUP BY 1")
def j05_target_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([("view",), ("click",), ("absent",)], "event_type string")
    return targets.join(s.table(spark, sf_dir, "events"), "event_type", "left").groupBy("event_type").agg(F.count("event_id").alias("n"))


@query("j06_semi_join", f"{_V} SELECT participant, count(*) AS n FROM mv WHERE meeting IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) AND meeting IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0) GROUP BY 1")
def j06_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = s.table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("meeting"))
    free = s.table(spark, sf_dir, "lineitem").filter("l_tax = 0").select(F.col("l_orderkey").alias("meeting"))
    return s.member_votes(spark, sf_dir).join(high, "meeting", "left_semi").join(free, "meeting", "left_semi").groupBy("participant").agg(F.count("*").alias("n"))


@query("j14_episode_counts", "SELECT n, count(o_orderkey) AS meetings FROM (VALUES (1, DATE '1993-03-01', DATE '1994-06-30'), (2, DATE '1996-01-01', DATE '1996-12-31')) e(n, a, b) LEFT JOIN orders ON o_orderdate::DATE BETWEEN a AND b GROUP BY 1")
def j14_episode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spark.createDataFrame([(i + 1, *e) for i, e in enumerate(EPISODES)], "n int, a string, b string")
    on = F.col("decided_on").between(F.col("a").cast("date"), F.col("b").cast("date"))
    return F.broadcast(spec).join(s.outcomes(spark, sf_dir), on, "left").groupBy("n").agg(F.count("meeting").alias("meetings"))


@query("j16_resolved_names", """WITH p AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), l AS (SELECT s_name AS label FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'X#' || string_split_regex(s_name, '[ #]')[-1] FROM supplier WHERE s_suppkey % 2 = 1),
u AS (SELECT string_split_regex(name, '[ #]')[-1] AS surname, min(id) AS sid FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT label, coalesce(p.id, sid) AS id FROM l LEFT JOIN p ON name = label LEFT JOIN u ON surname = string_split_regex(label, '[ #]')[-1]""")
def j16_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = s.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    tail = F.element_at(F.split("name", "[ #]"), -1)
    labels = people.select(F.when(F.pmod("id", F.lit(2)) == 0, F.col("name")).otherwise(F.concat(F.lit("X#"), tail)).alias("label"))
    return r.resolved_names(labels, people)


@query("j17_mentions", """WITH n AS (SELECT word AS surname, min(id) AS id FROM (VALUES (1, 'the'), (2, 'tion'), (3, 'der'), (4, 'the'), (5, 'queeux')) v(id, word) GROUP BY 1),
w AS (SELECT DISTINCT doc_id AS text_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS surname FROM documents)
SELECT text_id, list(DISTINCT id ORDER BY id)[1:2] AS ids FROM w JOIN n USING (surname) GROUP BY 1""")
def j17_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(1, "the"), (2, "tion"), (3, "der"), (4, "the"), (5, "queeux")], "id int, surname string")
    return r.mentions(s.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"), names, 2)


@query("j20_paired_labels", f"""{_V}, p AS (SELECT meeting, participant, (meeting + participant) % 3 = 0 AS predicted FROM mv WHERE participant % 10 <> 0), l AS (SELECT * FROM mv WHERE participant % 11 <> 0)
SELECT CASE WHEN l.meeting IS NULL OR p.meeting IS NULL THEN 'UNPAIRED' WHEN predicted AND dissent THEN 'TP' WHEN predicted THEN 'FP' WHEN dissent THEN 'FN' ELSE 'TN' END AS pair, count(*) AS n FROM p FULL JOIN l ON p.meeting = l.meeting AND p.participant = l.participant GROUP BY 1""")
def j20_paired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    mv = s.member_votes(spark, sf_dir)
    said = mv.filter("participant % 10 <> 0").select("meeting", "participant", (F.pmod(F.col("meeting") + F.col("participant"), F.lit(3)) == 0).alias("predicted"))
    pair = F.when(F.col("predicted").isNull() | F.col("dissent").isNull(), "UNPAIRED").when(F.col("predicted") & F.col("dissent"), "TP")
    pair = pair.when(F.col("predicted"), "FP").when(F.col("dissent"), "FN").otherwise("TN")
    return said.join(mv.filter("participant % 11 <> 0"), ["meeting", "participant"], "full_outer").groupBy(pair.alias("pair")).agg(F.count("*").alias("n"))


@query("j21_pseudonyms", f"""{_V}, k AS (SELECT participant, 'P' || row_number() OVER (ORDER BY participant) AS alias FROM (SELECT DISTINCT participant FROM mv))
SELECT alias, count(*) AS n FROM mv JOIN k USING (participant) GROUP BY 1""")
def j21_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    mv = s.member_votes(spark, sf_dir)
    number = F.row_number().over(Window.orderBy("participant"))  # a roster: one row a member
    roster = mv.select("participant").distinct().select("participant", F.concat(F.lit("P"), number.cast("string")).alias("alias"))
    return mv.join(roster, "participant").groupBy("alias").agg(F.count("*").alias("n"))


@query("j22_snapshot_diff", f"""{_STORED} SELECT count(*) FILTER (n.meeting IS NULL) AS missing_after, count(*) FILTER (o.meeting IS NULL) AS missing_before,
count(*) FILTER (o.meeting = n.meeting AND o.action IS DISTINCT FROM n.action) AS version_changed, count(*) FILTER (o.meeting = n.meeting AND o.level IS DISTINCT FROM n.level) AS value_changed FROM old o FULL JOIN new n ON o.meeting = n.meeting""")
def j22_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (x.select("meeting", F.col("action").alias("version"), F.col("level").alias("value")) for x in _stored(spark, sf_dir))
    return r.snapshot_diff(old, new, ["meeting"])


@query("j22_changed_keys", f"""{_STORED} SELECT coalesce(o.meeting, n.meeting) AS meeting, CASE WHEN o.meeting IS NULL THEN 'ADDED' WHEN n.meeting IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change
FROM (SELECT * FROM old WHERE meeting % 4 = 0 OR meeting % 7 = 0) o FULL JOIN new n ON o.meeting = n.meeting WHERE o.level IS DISTINCT FROM n.level OR o.action IS DISTINCT FROM n.action OR o.meeting IS NULL OR n.meeting IS NULL""")
def j22_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that differ between two snapshots, by stored hash trees."""
    old, new = _stored(spark, sf_dir)
    old = old.filter("meeting % 4 = 0 or meeting % 7 = 0")
    levels = ht.levels_for(max(old.count(), new.count()))
    base = f"{scratch_dir(spark)}/trees-{uuid.uuid4().hex}"
    trees = [ht.write_tree(x, ["meeting"], ["meeting", "decided_on", "action", "level"], f"{base}/{name}", levels) for name, x in (("old", old), ("new", new))]
    return ht.tree_diff(spark, *trees)


@query("a02_release_lookup", """SELECT l_orderkey AS meeting, l_linenumber AS round, o_orderkey AS release FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 2 = 0) ON o_orderkey = l_orderkey AND l_shipdate::DATE > d""")
def a02_release_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases = s.outcomes(spark, sf_dir).filter("meeting % 2 = 0").select(F.col("meeting").alias("release"), "decided_on")
    rows = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting"), F.col("l_linenumber").alias("round"), F.to_date("l_shipdate").alias("day"))
    return rows.join(releases, (F.col("release") == F.col("meeting")) & (F.col("day") > F.col("decided_on")), "left").select("meeting", "round", "release")


@query("a03_round_tallies", f"{_V} SELECT meeting, round, count(*) FILTER (NOT dissent) AS votes_for, count(*) FILTER (dissent) AS votes_against FROM votes GROUP BY 1, 2")
def a03_round_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.round_tallies(s.votes(spark, sf_dir))


@query("a04_member_labels", f"{_V} SELECT * FROM mv")
def a04_member_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.member_votes(spark, sf_dir)


@query("a05_a06_nested_counts", f"{_V}, n AS (SELECT meeting, count(*) AS k, count(DISTINCT participant) AS p FROM votes GROUP BY 1) SELECT coalesce(max(k), 0) AS most, coalesce(min(k), 0) AS least, max(p) AS most_members FROM n")
def a05_a06_nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = s.votes(spark, sf_dir).groupBy("meeting").agg(F.count("*").alias("k"), F.count_distinct("participant").alias("p"))
    return n.agg(F.coalesce(F.max("k"), F.lit(0)).alias("most"), F.coalesce(F.min("k"), F.lit(0)).alias("least"), F.max("p").alias("most_members"))


@query("a07_having", f"{_V} SELECT meeting, sum(dissent::INT)::BIGINT AS dissents FROM mv GROUP BY 1 HAVING sum(dissent::INT) <> 1")
def a07_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.member_votes(spark, sf_dir).groupBy("meeting").agg(F.sum(F.col("dissent").cast("int")).alias("dissents")).filter("dissents <> 1")


@query("a08_count_histogram", "WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT n AS n_children, count(*) AS n_parents FROM n GROUP BY 1")
def a08_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.count_histogram(s.table(spark, sf_dir, "customer"), s.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("a09_member_profiles", f"{_V} SELECT participant, count(*) AS n_votes, count(*) FILTER (dissent) AS n_dissents, min(meeting) AS first_meeting, max(meeting) AS last_meeting, coalesce((list(meeting ORDER BY meeting DESC) FILTER (dissent))[1:6], []) AS newest_dissents FROM mv GROUP BY 1")
def a09_member_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.member_profiles(s.member_votes(spark, sf_dir))


@query("a14_quantiles", """SELECT lang, probability, round(q, 6) AS quantile FROM (SELECT lang, unnest([0.1, 0.5, 0.95]::DOUBLE[]) AS probability, unnest(quantile_cont(n_chars, [0.1, 0.5, 0.95])) AS q FROM documents GROUP BY 1)""")
def a14_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.exact_quantiles(s.table(spark, sf_dir, "documents"), "lang", "n_chars", [0.1, 0.5, 0.95])
    return found.withColumn("quantile", F.round("quantile", 6))


@query("a18_wide_features", f"WITH {s.LEVELS_SQL} SELECT month(day)::INTEGER AS m, arg_max(level, day) FILTER (series_id = 'view') AS \"view\", arg_max(level, day) FILTER (series_id = 'click') AS click FROM lev GROUP BY 1")
def a18_wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.daily_levels(spark, sf_dir).groupBy(F.month("day").alias("m")).pivot("series_id", ["view", "click"]).agg(F.max_by("level", "day"))


@query("a19_standardise", "SELECT avg(l_quantity) AS mean, stddev_pop(l_quantity) AS deviation FROM lineitem HAVING stddev_pop(l_quantity) > 0")
def a19_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.standardised(s.table(spark, sf_dir, "lineitem"), "l_quantity")


@query("a20_active_range", f"{_V} SELECT participant, least(min(meeting), 500) AS first_meeting, greatest(max(meeting), 1000) AS last_meeting FROM mv GROUP BY 1")
def a20_active_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    mv = s.member_votes(spark, sf_dir)
    stored = mv.select("participant").distinct().select("participant", F.explode(F.expr("array(500L, 1000L)")).alias("meeting"))
    both = mv.select("participant", "meeting").unionByName(stored)
    return both.groupBy("participant").agg(F.min("meeting").alias("first_meeting"), F.max("meeting").alias("last_meeting"))


@query("a21_violation_tallies", "SELECT rule, count(*) AS n, count(DISTINCT key) AS cases FROM (SELECT 'QUANTITY_RANGE' AS rule, l_orderkey AS key FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 49 UNION ALL SELECT 'FLAG_DOMAIN', l_orderkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'DISCOUNT_OVER_TAX', l_orderkey FROM lineitem WHERE NOT l_discount >= l_tax) GROUP BY 1")
def a21_violation_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p07_violations(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("cases"))


@query("u01_symmetric_difference", "(SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_tax = 0 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_discount = 0 AND l_quantity > 45) UNION ALL (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_discount = 0 AND l_quantity > 45 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_tax = 0)")
def u01_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda cond: s.table(spark, sf_dir, "lineitem").filter(cond).select(F.col("l_suppkey").alias("id"))
    return r.symmetric_difference(pick("l_tax = 0"), pick("l_discount = 0 and l_quantity > 45"))


@query("u02_set_coverage", f"{_V}, w AS (SELECT DISTINCT round AS g, participant AS m FROM votes WHERE participant % 2 = 0), h AS (SELECT DISTINCT round AS g, participant AS m FROM votes WHERE dissent) SELECT g AS round, coalesce(list(w.m ORDER BY w.m) FILTER (h.m IS NULL), []) AS missing, coalesce(list(h.m ORDER BY h.m) FILTER (w.m IS NULL), []) AS extra FROM w FULL JOIN h USING (g, m) GROUP BY 1".replace("w.m ORDER BY w.m", "m ORDER BY m").replace("h.m ORDER BY h.m", "m ORDER BY m"))
def u02_set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = s.votes(spark, sf_dir)
    return r.coverage(v.filter("participant % 2 = 0"), v.filter("dissent"), "round", "participant")


@query("u03_overlap", f"{_V} SELECT meeting, len(list_intersect(list(participant) FILTER (dissent), list(participant) FILTER (NOT dissent))) > 0 AS overlaps FROM votes GROUP BY 1 HAVING count(*) FILTER (dissent) > 0 AND count(*) FILTER (NOT dissent) > 0")
def u03_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = s.votes(spark, sf_dir).groupBy("meeting").agg(*[F.collect_set(F.when(F.col("dissent") == d, F.col("participant"))).alias(n) for n, d in (("a", True), ("b", False))])
    return sides.filter("size(a) > 0 and size(b) > 0").select("meeting", F.arrays_overlap("a", "b").alias("overlaps"))


@query("u04_mixed_union", "SELECT 'det' AS kind, l_returnflag AS name, count(*) AS n, NULL::DOUBLE AS cost FROM lineitem GROUP BY 2 UNION ALL SELECT 'model', o_orderstatus, count(*), round(sum(o_totalprice)) FROM orders GROUP BY 2")
def u04_mixed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("det"))
    b = s.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice")).alias("cost")).withColumn("kind", F.lit("model"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u05_distinct_keep_last", "SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def u05_distinct_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.keep_last(s.table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], F.col("doc_id"))


@query("o02_top_parents", "SELECT l_suppkey, rank, l_orderkey, q FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_orderkey)::INTEGER AS rank FROM (SELECT l_suppkey, l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE rank <= 4")
def o02_top_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = s.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_quantity").alias("q"))
    return r.top_per_group(best, ["l_suppkey"], [F.col("q").desc(), F.col("l_orderkey")], 4)


@query("o03_newest_then_important", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id)::INTEGER AS rank FROM n WHERE k <= 30 AND value > 20) SELECT user_id, rank, event_id, value FROM m WHERE rank <= 5""")
def o03_newest_then_important(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "events")
    kept = r.top_then_top(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id")], 30, F.col("value") > 20, [F.col("value").desc(), F.col("ts"), F.col("event_id")], 5)
    return kept.select("user_id", "rank", "event_id", "value")


@query("o04_newest_documents", f"""WITH {_DOCS}, {s.CUTOFFS_SQL}, k AS (SELECT meeting_id, doc_id, row_number() OVER (PARTITION BY meeting_id ORDER BY published DESC, usage, doc_id)::INTEGER AS rank FROM docs JOIN cut ON published < cutoff)
SELECT * FROM k WHERE rank <= 5""")
def o04_newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.newest_before(_documents(spark, sf_dir), s.cutoffs(spark, sf_dir), 5, [F.col("usage"), F.col("doc_id")])
    return found.select("meeting_id", "doc_id", "rank")


@query("o07_arg_max_lexicographic", "SELECT l_suppkey, first(l_orderkey ORDER BY l_quantity DESC, l_discount DESC, l_orderkey DESC) AS best FROM lineitem GROUP BY 1")
def o07_arg_max_lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_quantity", "l_discount", "l_orderkey")).alias("best"))


@query("o08_plurality", "SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE k = 1")
def o08_plurality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.plurality(s.table(spark, sf_dir, "documents"), "source", "lang")
