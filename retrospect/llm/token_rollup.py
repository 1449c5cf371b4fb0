"""Token counts: additive totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes holds inserts, deletes and revisions of per-document counts. It is reduced to one signed row a key
(documents and tokens to add) before anything is shuffled by key, and written as the partition of its batch id.
Committing a batch id again overwrites its own partition with the same rows, so replays after a lost executor or driver
change nothing; a batch id that the ledger already holds, an empty batch's too, is skipped unless `again` is asked for. Totals are the sums of
all partitions; keys whose documents have all gone are left out.

Null source or language is a key of its own, null text counts no tokens, a null count is 0, repeated rows are counted
each, an empty batch leaves the totals as they are, other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, ship_package, staged, word_count

KEYS = ["source", "lang", "tokenizer"]
_DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch string"


class TokenRollup:
    """The totals under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{scratch_dir(spark)}/token-rollup-{uuid.uuid4().hex}"
        spark.createDataFrame([], _DELTAS).write.mode("append").partitionBy("batch").parquet(self.path)

    def _deltas(self) -> DataFrame:
        return self.spark.read.schema(_DELTAS).parquet(self.path)

    def committed(self, batch: str) -> bool:
        return not self._deltas().filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame, again: bool = False) -> bool:
        """changes: source, lang, tokenizer, change ('insert', 'delete' or 'revise'), tokens, old_tokens.

        tokens is the count that an insert adds or a revision sets, old_tokens the one that a delete or revision takes
        back. Returns whether the batch was written.
        """
        if not again and self.committed(batch):
            return False
        new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        signed = changes.select(
            *KEYS,
            F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).otherwise(0).alias("docs"),
            F.when(F.col("change") == "insert", new).when(F.col("change") == "delete", -old).otherwise(new - old).alias("tokens"),
        )
        delta = signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        # A row of zeros marks the batch as committed even if it changes nothing.
        mark = self.spark.range(1).select(*[F.lit(None).cast("string").alias(k) for k in KEYS], F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"))
        (
            delta.unionByName(mark).withColumn("batch", F.lit(batch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(self.path)
        )
        return True

    def compacted(self, path: str | None = None) -> TokenRollup:
        """The same totals and ledger under another folder: one partition of totals, and a row of zeros for each batch.

        The old folder stays as it is until the caller drops it, so a compaction that breaks off changes nothing.
        """
        new = TokenRollup(self.spark, path)
        marks = self._deltas().select("batch").distinct().select(*[F.lit(None).cast("string").alias(k) for k in KEYS], *[F.lit(0).cast("long").alias(c) for c in ("docs", "tokens")], "batch")
        self.totals().withColumn("batch", F.lit("totals")).unionByName(marks).write.mode("append").partitionBy("batch").parquet(new.path)
        return new

    def totals(self) -> DataFrame:
        summed = self._deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.filter("docs <> 0 or tokens <> 0")


def byte_token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, source, lang, n_chars, words and bpe (tokens of a byte-level vocabulary) for every row of docs."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tokens import byte_encoding

        encode = byte_encoding(ranks_path, pattern).encode_ordinary
        for batch in batches:
            yield batch.assign(bpe=[len(encode(t)) if t else 0 for t in batch["text"]]).drop(columns="text")

    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.length("text").cast("long").alias("chars"),
        word_count(F.col("text")).alias("words"),
        "text",
    )
    return plain.mapInPandas(count, "doc_id long, source string, lang string, chars long, words long, bpe long")


def rollup_history(docs: DataFrame, removed: DataFrame, ranks_path: str, pattern: str, versions: tuple[str, str]) -> DataFrame:
    """Totals after a history of batches over docs: load, a replay of it, revision of estimates, removals.

    The load inserts exact counts for the byte-level version and an estimate from the text's length for the word
    version; the revision sets the latter's exact counts; rows whose id is in `removed` are deleted last.
    """
    words_version, bytes_version = versions
    counted = staged(byte_token_counts(docs, ranks_path, pattern), "token-counts")
    estimate = F.floor(F.coalesce("chars", F.lit(0)) / 6).cast("long")
    none = F.lit(None).cast("long")

    def change(kind: str, rows: DataFrame, version: str, tokens, old) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(kind).alias("change"), tokens.alias("tokens"), old.alias("old_tokens"))

    words, bpe = F.col("words"), F.col("bpe")
    load = change("insert", counted, words_version, estimate, none).unionByName(change("insert", counted, bytes_version, bpe, none))
    gone = counted.join(removed.select("doc_id").distinct(), "doc_id", "left_semi")
    rollup = TokenRollup(docs.sparkSession)
    rollup.commit("load", load)
    rollup.commit("load", load, again=True)
    rollup.commit("revise", change("revise", counted, words_version, words, estimate))
    rollup.commit("remove", change("delete", gone, words_version, none, words).unionByName(change("delete", gone, bytes_version, none, bpe)))
    return rollup.totals()
