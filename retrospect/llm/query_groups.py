"""Query sets in groups of bounded size, for searches that leave the searched blocks where they are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import staged


def query_groups(queries: DataFrame, size: Column, bound: int) -> Iterator[list[Row]]:
    """The rows of `queries` with `number` (theirs alone) in groups whose `size` adds up to `bound` at most, or of one row.

    A group is what a search sends to all tasks at once: it passes through the driver, a whole query set never does.
    The number of groups is doubled until every group is within the bound, so the bound is checked, not expected.
    """
    numbered = staged(queries.withColumn("number", F.monotonically_increasing_id()).withColumn("query_size", size), "queries")
    total = numbered.agg(F.coalesce(F.sum("query_size"), F.lit(0))).first()[0]
    groups = max(1, -(-2 * total // bound)) if total > bound else 1
    while True:
        own = F.pmod(F.xxhash64("number"), F.lit(groups))
        sums = numbered.groupBy(own.alias("group")).agg(F.sum("query_size").alias("size"), F.count("*").alias("rows"))
        if sums.filter((F.col("size") > bound) & (F.col("rows") > 1)).isEmpty():
            break
        groups *= 2
    for group in range(groups):
        rows = numbered.filter(own == group).drop("query_size").collect()
        if rows:
            yield rows
