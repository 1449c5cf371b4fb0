"""Sources and sinks: folding feeds, upserts, verified inserts and document registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key, the last in order."""
    newest = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")


def folded_corpus(rows: DataFrame) -> DataFrame:
    """One row a date with the last Statement and the last Minute text of rows (date, kind, text, ordinal)."""
    return rows.groupBy("date").pivot("kind", ["Statement", "Minute"]).agg(F.max_by("text", "ordinal"))


def parsed_feed(rows: DataFrame) -> DataFrame:
    """Raw feed rows (date, value_raw, realtime_start, realtime_end) with the number ("." is missing), proxy dates and mode."""
    proxy = F.col("realtime_start").isNull()
    return rows.select(
        "series_id", "date", "value_raw",
        F.when(F.col("value_raw") != ".", F.expr("try_cast(value_raw AS double)")).alias("value"),
        F.coalesce("realtime_start", "date").alias("realtime_start"),
        F.coalesce("realtime_end", F.lit("9999-12-31").cast("date")).alias("realtime_end"),
        F.when(proxy, "OBSERVATION_DATE_PROXY").otherwise("VINTAGE").alias("mode"),
    )


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: a batch's row replaces the stored row of its key."""
    both = stored.withColumn("__batch", F.lit(0)).unionByName(batch.withColumn("__batch", F.lit(1)))
    return keep_last(both, keys, F.col("__batch")).drop("__batch")


def missing_rows(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key is not stored (insert or ignore; skip of loaded series)."""
    return batch.join(stored.select(*keys), keys, "left_anti")


def conflicts(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are stored with other values than the batch expects."""
    values = [c for c in batch.columns if c not in keys]
    expected = batch.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return stored.join(expected, keys).filter(~same).select(*keys)


def widened(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Union of an old shape and a new one; columns that the old lacks get their defaults."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def registered(documents: DataFrame) -> DataFrame:
    """documents (text, source) with content hash, id and whether the same content has several provenances."""
    hashed = documents.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    known = hashed.groupBy("content_hash").agg(F.count_distinct("source").alias("n_sources"))
    return hashed.join(known, "content_hash").withColumn("document_id", F.concat(F.lit("doc-"), F.left("content_hash", F.lit(24))))
