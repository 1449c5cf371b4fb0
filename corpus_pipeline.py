"""The corpus pipeline: STAGES in order, each over what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrospect.llm.common import staged, table
from retrospect.llm.line_dedup import dedup_lines
from retrospect.llm.mixing import mix_sources, taken_copies
from retrospect.llm.ngram_join import ngram_join
from retrospect.llm.packing import pack_documents
from retrospect.llm.quality import kept_documents
from retrospect.llm.queries import tokenizer_path


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and n_chars to match where there is such a column."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines above their host's limit.

    Null and empty texts fail the rules; repeated rows are judged each; an empty table gives no rows.
    """
    return _with_text(kept_documents(docs), F.col("text")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one.

    Null and empty texts stay as they are; rows with a null id lose nothing; an empty table gives no rows.
    """
    counts = "line_dedup"
    while counts in docs.columns:
        counts += "_"
    return _with_text(dedup_lines(docs, percent=80, result=counts), F.col("text")).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles at 0.8 the one with the smallest id; documents without words stay.

    Rows with a null id stay; of rows that repeat an id one stays, unless they have no words; an empty table gives no rows.
    """
    judged = ngram_join(docs, n=5, percent=80).select(F.col("doc_id").alias("__id"), "n_shingles", "component_id").distinct()
    kept = judged.filter("component_id is null or component_id = __id").groupBy("__id").agg(F.max("n_shingles").alias("__size"))
    own = Window.partitionBy("__id").orderBy(F.xxhash64("__row.text"))
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__doc"))
    found = rows.join(kept, F.col("__doc").eqNullSafe(F.col("__id")))
    ranked = found.withColumn("__rank", F.row_number().over(own))
    return ranked.filter("__rank = 1 or __size = 0 or __id is null").select("__row.*")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes of each document; the document at a source's cut is cut.

    Texts without words have no size and are never taken; null sources are one source; an empty table gives no rows.
    """
    mixed = mix_sources(docs, extra=(F.struct("*").alias("__row"),))
    copies = taken_copies(mixed, F.col("__row.text"))
    made = {"text": F.col("copy_text"), "n_chars": F.length("copy_text").cast("long")}
    return copies.select(*[made.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens; null and empty texts are the end's token alone."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("source mixing", mix_to_targets),
    ("best-fit packing", pack_sequences),
]
#: Tokenizers and set joins can't be put in SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for label, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), label.replace(" ", "-"))
    return docs
