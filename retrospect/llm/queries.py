"""One query for each training-data operator, over its whole table with production parameters, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ball_tree import lexical_search
from .bpe import decode_ids, encode_texts
from .common import table
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .negatives import mine_hard_negatives, quantised
from .ngram_join import ngram_join
from .packing import pack_documents
from .quality import quality_rules
from .sharding import shard_by_bytes
from .substrings import dedup_substrings
from .token_rollup import rollup_history
from .topk import top_k
from .urls import judge_urls


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"), percent=80)
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40, row_overhead=16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_substrings(table(spark, sf_dir, "documents"), size=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    versions = ("words-1", "byte_bpe_50k-1")
    return rollup_history(table(spark, sf_dir, "documents"), toxic, ranks, public_tokenizers.PATTERN, versions)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table(spark, sf_dir, "embeddings"), label, scale=256)
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    hexed = lambda text: F.sha2(text.cast("binary"), 256)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hexed(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hexed(F.col("text")).alias("decoded_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20, b=25)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_url_filters": op3_url_filters,
    "op4_source_mixing": op4_source_mixing,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality_rules": op9_quality_rules,
    "op10_topk_search": op10_topk_search,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op3_url_filters": r"""
WITH split AS (
  SELECT row_number() OVER () AS row, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT s.row, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS label
  FROM split s JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY s.row
), r AS (
  SELECT s.*, f.rule, f.label, coalesce(page_id % 5 = 0, false) AS held,
         string_split('^^^' || regexp_replace(regexp_replace(lower(host || path), '[0-9]', '0', 'g'), '[^a-z0./_-]', '~', 'g') || '$', '') AS c
  FROM split s LEFT JOIN fits f USING (row)
), pos AS (
  SELECT row, label, held, c[i] || c[i + 1] || c[i + 2] || c[i + 3] AS gram
  FROM (SELECT *, unnest(range(1, len(c) - 2)) AS i FROM r)
), g4 AS (
  SELECT gram, count(*) FILTER (NOT held AND label = 'allow') AS a, count(*) FILTER (NOT held AND label = 'block') AS r FROM pos GROUP BY gram
), m1 AS (
  SELECT *, sum(a) OVER () AS na, count(*) FILTER (a > 0) OVER () AS ta, sum(r) OVER () AS nr, count(*) FILTER (r > 0) OVER () AS tr
  FROM (SELECT gram[4] AS g, sum(a) AS a, sum(r) AS r FROM g4 GROUP BY 1)
), p1 AS (
  SELECT g, CASE WHEN na > 0 THEN (a + ta * (1.0::DOUBLE / 33)) / (na + ta) ELSE 1.0::DOUBLE / 33 END AS ba,
            CASE WHEN nr > 0 THEN (r + tr * (1.0::DOUBLE / 33)) / (nr + tr) ELSE 1.0::DOUBLE / 33 END AS br FROM m1
), m2 AS (
  SELECT *, sum(a) OVER w AS na, count(*) FILTER (a > 0) OVER w AS ta, sum(r) OVER w AS nr, count(*) FILTER (r > 0) OVER w AS tr
  FROM (SELECT gram[3:4] AS g, sum(a) AS a, sum(r) AS r FROM g4 GROUP BY 1) WINDOW w AS (PARTITION BY g[1:1])
), p2 AS (
  SELECT m.g, CASE WHEN na > 0 THEN (a + ta * ba) / (na + ta) ELSE ba END AS ba, CASE WHEN nr > 0 THEN (r + tr * br) / (nr + tr) ELSE br END AS br
  FROM m2 m JOIN p1 p ON m.g[2:2] = p.g
), m3 AS (
  SELECT *, sum(a) OVER w AS na, count(*) FILTER (a > 0) OVER w AS ta, sum(r) OVER w AS nr, count(*) FILTER (r > 0) OVER w AS tr
  FROM (SELECT gram[2:4] AS g, sum(a) AS a, sum(r) AS r FROM g4 GROUP BY 1) WINDOW w AS (PARTITION BY g[1:2])
), p3 AS (
  SELECT m.g, CASE WHEN na > 0 THEN (a + ta * ba) / (na + ta) ELSE ba END AS ba, CASE WHEN nr > 0 THEN (r + tr * br) / (nr + tr) ELSE br END AS br
  FROM m3 m JOIN p2 p ON m.g[2:3] = p.g
), m4 AS (
  SELECT gram AS g, a, r, sum(a) OVER w AS na, count(*) FILTER (a > 0) OVER w AS ta, sum(r) OVER w AS nr, count(*) FILTER (r > 0) OVER w AS tr
  FROM g4 WINDOW w AS (PARTITION BY gram[1:3])
), p4 AS (
  SELECT m.g, ln(CASE WHEN na > 0 THEN (a + ta * ba) / (na + ta) ELSE ba END) - ln(CASE WHEN nr > 0 THEN (r + tr * br) / (nr + tr) ELSE br END) AS s
  FROM m4 m JOIN p3 p ON m.g[2:4] = p.g
), scored AS (
  SELECT row, round(avg(s), 9) AS score FROM pos JOIN p4 ON gram = g GROUP BY row
), j AS (SELECT r.*, score FROM r JOIN scored USING (row)),
bins AS (
  SELECT floor(score / 0.01::DOUBLE)::BIGINT AS bin, count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label = 'block') AS b
  FROM j WHERE held AND label IS NOT NULL GROUP BY 1
), rates AS (
  SELECT bin, sum(a) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE / nullif(sum(a) OVER (), 0) AS kept,
         coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / nullif(sum(b) OVER (), 0) AS stopped
  FROM bins
), best AS (
  SELECT coalesce((SELECT bin * 0.01::DOUBLE FROM rates WHERE kept IS NOT NULL AND stopped IS NOT NULL
                   ORDER BY round(kept + stopped, 9) DESC, abs(bin), bin LIMIT 1), 0.0) AS threshold
)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, score, threshold
FROM j, best
""",
    "op10_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
    "op11_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.vec, c.vec)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
  FROM s WHERE alike QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, positive_id, positive_rank::INTEGER AS positive_rank, vec_id AS negative_id, positive_score, score AS negative_score,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
""",
    "op13_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), c AS (
  SELECT count(*) AS total, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0
), tf AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term
), w AS (
  SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, total
), i AS (
  SELECT number, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS number, item_id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
  GROUP BY number, item_id, term
), m AS (SELECT row, doc_id, 100 - 25 + (25 * len(terms) * total) // words AS m FROM d, c),
s AS (
  SELECT number, item_id, m.row, m.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL
)
SELECT item_id, doc_id, score,
       (row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank
FROM s WHERE score > 0 QUALIFY rank <= 20
""",
    "op4_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size::VARCHAR) AS key FROM sized
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
  FROM sized GROUP BY source
), lev AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST)
), tgt AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, ratio) FROM lev WHERE level <= ratio) * weight, cap)) AS target
  FROM lev
), placed AS (
  SELECT k.*, t.source_size, t.target, floor(t.target)::BIGINT // greatest(t.source_size, 1) AS whole,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM keyed k JOIN tgt t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - start)))::BIGINT AS taken
FROM placed
""",
    "op9_quality_rules": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM docs)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) v(d) GROUP BY rid
), raw AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS line FROM docs
), lines AS (
  SELECT rid, source, line, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid
), host AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
freq AS (
  SELECT l.source, l.norm FROM lines l JOIN host h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.norm, h.n HAVING count(DISTINCT rid) > 10 AND count(DISTINCT rid) > 0.1::DOUBLE * h.n
), lost AS (
  SELECT l.rid, sum(l.n) AS n FROM lines l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY l.rid
), m AS (
  SELECT d.doc_id, len(d.words)::BIGINT AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS n_boilerplate_words
  FROM docs d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_boilerplate_words >= 0.5::DOUBLE * n_words AS kept
FROM m
""",
}
