"""Quality rules: fixed per-document rules, then the frequency of lines across the documents of a host.

Lines are normalised (ASCII white space collapsed and trimmed, lower case) and hashed. A line that more than
`max(min_docs, host_share * documents of the host)` documents of one host carry is boilerplate. A document that keeps less than
`keep_share` of its words without its boilerplate lines is rejected as depleted, as is one that fails the base rules.

The boilerplate table is small by construction: a host with lines L per document has at most L / host_share such
lines. It is broadcast only if it has at most `broadcast_lines` lines, else joined by shuffle. Everything is DataFrame
expressions; the per-document measures stay inside one row, so no words are shuffled.

Null text is empty and fails the base rules; a null host is a host of its own; repeated rows count as documents of
their own; an empty table gives no rows. `extra` columns of docs are carried along; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD_PATTERN, staged, words_of

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def normalised_lines(text: Column) -> Column:
    """Array of a text's non-empty normalised lines."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(F.lower(spaced), "\n"), lambda line: F.trim(line)), lambda line: line != "")


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = 10, host_share: float = 0.1) -> DataFrame:
    """host, lines (array of hashes) of the lines above their host's limit."""
    lines = docs.select(F.col(host).alias("host"), "text")
    seen = (
        lines.select("host", F.explode(F.array_distinct(F.transform(normalised_lines(F.col("text")), lambda line: F.xxhash64(line)))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("docs"))
        .filter(F.col("docs") > min_docs)
    )
    hosts = lines.groupBy("host").agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "h")
    over = seen.join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("docs") > F.lit(host_share) * F.col("host_docs"))
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def without_lines(text: Column, lines: Column) -> Column:
    """text without the lines whose normalised form hashes to one of lines; null lines leave it as it is."""
    hashed = lambda line: F.xxhash64(F.array_join(normalised_lines(line), "\n"))
    return F.when(lines.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(lines, hashed(line))), "\n"))


def window_hashes(words: Column) -> Column:
    """Hashes of the 3-word windows of an array of words."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(each, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_docs: int = 10,
    host_share: float = 0.1,
    keep_share: float = 0.5,
    broadcast_lines: int = 1_000_000,
    extra: tuple[Column, ...] = (),
    barrier: bool = False,
    stripped: str | None = None,
) -> DataFrame:
    """doc_id, the base measures, n_boilerplate_words, base_failed and kept for every row of docs.

    stripped names a column for the text without its boilerplate lines, which `kept` judges depletion on.
    """
    boilerplate = staged(frequent_lines(docs, host, min_docs, host_share), "frequent-lines")
    size = boilerplate.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    if size <= broadcast_lines:
        boilerplate = F.broadcast(boilerplate)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.col(host).alias("__host"), text.alias("__text"), words_of(F.col("text")).alias("__words"), *extra)
    lines = F.split("__text", "\n")
    with_words = F.filter(lines, lambda line: F.translate(line, SPACES, "") != "")
    bare = F.translate("__text", SPACES, "")
    # Most texts repeat no window; only those that do are sorted.
    hashed = own.withColumn("__windows", window_hashes(F.col("__words")))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    measured = hashed.withColumn("__sorted", F.when(repeats, placed).otherwise(none)).withColumn(
        "__starts",
        F.sort_array(
            F.transform(
                F.filter(
                    F.col("__sorted"),
                    lambda x, k: x["h"].eqNullSafe(F.get("__sorted", k + 1)["h"]) | x["h"].eqNullSafe(F.get("__sorted", k - 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(F.col("__starts"), lambda s, k: F.least(F.lit(3), F.coalesce(F.get("__starts", k + 1) - s, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    joined = measured.join(boilerplate, F.col("__host").eqNullSafe(F.col("host")), "left")
    lost = F.aggregate(
        F.filter(normalised_lines(F.col("__text")), lambda line: F.array_contains(F.col("lines"), F.xxhash64(line))),
        F.lit(0).cast("long"),
        lambda total, line: total + F.regexp_count(line, F.lit(WORD_PATTERN)),
    )
    names = [c for c in own.columns if c not in ("doc_id", "__host", "__text", "__words")]
    if barrier:
        names.append(F.monotonically_increasing_id().alias("__at"))
    left = [] if stripped is None else [without_lines(F.col("__text"), F.col("lines")).alias(stripped)]
    counted = joined.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(with_words) - F.size(F.array_distinct(with_words))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.when(F.col("lines").isNull(), F.lit(0).cast("long")).otherwise(lost).alias("n_boilerplate_words"),
        *names,
        *left,
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_boilerplate_words") < F.lit(keep_share) * F.col("n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def kept_documents(docs: DataFrame, **rules) -> DataFrame:
    """The rows of docs that the quality rules keep, with all their columns; their texts are without boilerplate lines."""
    # Spark would move a filter below the measures and spell them out in it once more for every word; a row number
    # among them keeps it where it is.
    judged = quality_rules(docs, extra=(F.struct("*").alias("__row"),), barrier=True, stripped="__left", **rules)
    names = [F.col("__left").alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return judged.filter("kept and __at >= 0").select(*names)
