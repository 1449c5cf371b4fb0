"""Sharding: contiguous shards of near-equal bytes, cut from global prefix sums of row sizes.

Rows are range-sorted by id into partitions, each partition reports one total, the totals' prefix sums give every
partition its first byte, and a running sum inside the partition gives every row its place in the whole. A row goes to
the shard in whose equal share its middle byte falls, so shards are contiguous and differ by at most one row's bytes.

Null ids sort first, null text has no bytes, rows with the same id are ordered by their text's CRC and size (identical
rows are interchangeable), an empty table gives no rows, other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged


def shard_by_bytes(docs: DataFrame, shards: int = 40, row_overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + row_overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    # Written once: range bounds come from a sample, so both passes below must see the same partitions.
    ranged = staged(
        sized.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()),
        "shard-rows",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("first_byte"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("first_row"),
            F.sum("part_bytes").over(everything).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.join(offsets, "part")
        .withColumn("end_byte", F.col("first_byte") + F.sum("size").over(inside))
        .withColumn("row", F.col("first_row") + F.count("*").over(inside) - 1)
        .withColumn(
            "shard",
            F.least(F.lit(shards - 1), F.expr(f"(2 * end_byte - size) * {shards} div (2 * all_bytes)")).cast("int"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("shard_row")).alias("slot")
    )
