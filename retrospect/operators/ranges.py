"""What lies before a row in its series, found by ranges: no task holds a whole series, however long it is.

Rows are dealt to ranges of (keys, order). A range gives a small state for each of its series (totals, last values), the
states are combined in the order of ranges, and a range starts from the state that reaches it. Only the first series of
a range can have begun in an earlier one, so the states that are carried into ranges are at most as many as ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

RANGE = "__range"


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with the number of their range, written once, so that all that follows sees the same ranges.

    Rows that are equal in keys and order share a range.
    """
    return staged(rows.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def with_earlier(
    rows: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None
) -> DataFrame:
    """Ranged rows with, for each name, the total (0 if none) or the last value that is not null (null if none) of the rows before.

    Null keys are a series of their own, null order comes first. Among rows equal in keys and order the order is any, so
    callers give an order without ties. An empty table stays empty.
    """
    totals, lasts = totals or {}, lasts or {}
    own = {n: f"__own_{n}" for n in (*totals, *lasts)}
    here = rows.withColumns({own[n]: c for n, c in (totals | lasts).items()})
    at = F.struct(*order)
    states = here.groupBy(*keys, RANGE).agg(
        *[F.sum(own[n]).alias(n) for n in totals],
        *[F.max_by(own[n], F.when(F.col(own[n]).isNotNull(), at)).alias(n) for n in lasts],
    )
    ahead = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    reached = states.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        F.col(RANGE).alias("__reached"),
        F.count("*").over(ahead).alias("__n"),
        *[F.sum(n).over(ahead).alias(f"__in_{n}") for n in totals],
        *[F.last(n, ignorenulls=True).over(ahead).alias(f"__in_{n}") for n in lasts],
    ).filter("__n > 0")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys], F.col(RANGE) == F.col("__reached"))
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    found = here.join(F.broadcast(reached), same, "left").withColumns(
        {n: F.coalesce(F.sum(own[n]).over(inside), nothing) + F.coalesce(F.col(f"__in_{n}"), nothing) for n in totals}
        | {n: F.coalesce(F.last(own[n], ignorenulls=True).over(inside), F.col(f"__in_{n}")) for n in lasts}
    )
    return found.select(*rows.columns, *totals, *lasts)
