"""Mixing sources to target weights: hash-random keys, range-sorted within each source, cut at exact word budgets.

Every document gets a random key from a hash of its id. Within a source, documents are ordered by key: a bucket of the
key's leading digits is the range partition, bucket totals give prefix sums, and a running sum inside the bucket gives
each document the words before it. A source whose budget is over its size repeats whole epochs; the rest of the budget
is cut exactly, inside a document if need be.

Sources weigh by their place in code point order (null last). Targets stop at `most` times their source's size; what
is over goes to the other sources by weight, until none is above. Null text has size 0; rows with the same id and size
are interchangeable; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count, words_of

_UP_TO_NOW = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target from one row a source (a list of sources, not of documents)."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    capped = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(whole) * F.lit(share)
    # With the sources before this one at their caps, the level that shares out the rest by weight.
    level = (total - F.coalesce(F.sum("cap").over(order.rowsBetween(*_BEFORE)), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    levelled = capped.withColumn("level", level).withColumn("held", F.col("level") <= F.col("cap") / F.col("weight"))
    chosen = F.min(F.when(F.col("held"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(chosen["level"] * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix-1",
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs; `extra` columns of docs are carried along."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra)
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = staged(
        sized.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), id_text, F.col("size").cast("string")).cast("binary")))
        .withColumn("bucket", F.substring("key", 1, 3)),
        "mix-rows",
    )
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    starts = buckets.select(
        F.col("source").alias("s"),
        F.col("bucket").alias("b"),
        F.coalesce(
            F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*_BEFORE)), F.lit(0)
        ).alias("bucket_start"),
    ).join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(*_UP_TO_NOW)
    rows = keyed.withColumn("end", F.sum("size").over(inside)).join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    )
    budget = F.floor("target").cast("long")
    whole = F.expr("floor(target) div greatest(source_size, 1)")
    left = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("bucket_start") + F.col("end") - F.col("size"))))
    names = [name for name in sized.columns if name not in ("doc_id", "source", "size")]
    return rows.select(
        "doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), *names
    )


def taken_copies(mixed: DataFrame, text: Column) -> DataFrame:
    """One row a whole or partial copy that the mix takes: column copy_text holds its words up to the cut."""
    whole = F.expr("taken div greatest(size, 1)")
    rest = F.expr("taken % greatest(size, 1)")
    head = F.array_join(F.slice(words_of(text), 1, rest.cast("int")), " ")
    copies = F.concat(
        F.array_repeat(text, whole.cast("int")),
        F.when(rest > 0, F.array(head)).otherwise(F.array().cast("array<string>")),
    )
    return mixed.withColumn("copy_text", F.explode(copies))
