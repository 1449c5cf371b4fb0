"""Joins of dates with intervals by buckets of days, and values carried along a date axis in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ORIGIN = "1970-01-01"


def _bucket(day: Column, days: int) -> Column:
    return F.floor(F.date_diff(day, F.lit(_ORIGIN).cast("date")) / F.lit(days)).cast("int")


def interval_join(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, days: int = 32, by: tuple[str, ...] = (), bucket: str | None = None) -> DataFrame:
    """Rows of both, equal in `by`, where start <= at < end; a null start or end is open.

    An equi-join on buckets of `days`: an interval has a row for every bucket that it touches between the first and
    last point, a point lies in one, so the rows made are about as many as the result's. No side is broadcast by force,
    and a bucket that is too large for a task is split by the engine's skew join. bucket: a name under which the buckets'
    numbers stay, so that what is grouped by it, `by` and a point's other columns needs no shuffle.
    """
    first, last = points.agg(F.min(at), F.max(at)).first()  # two dates
    low = F.greatest(F.coalesce(F.col(start), F.lit(first)), F.lit(first))
    high = F.least(F.coalesce(F.date_sub(F.col(end), 1), F.lit(last)), F.lit(last))
    inside = (F.col(start).isNull() | (F.col(start) <= F.lit(last))) & (low <= high)
    spread = intervals.filter(inside).withColumn("__bucket", F.explode(F.sequence(_bucket(low, days), _bucket(high, days))))
    dealt = points.withColumn("__bucket", _bucket(F.col(at), days))
    joined = spread.join(dealt, [*by, "__bucket"])
    found = joined.withColumnRenamed("__bucket", bucket) if bucket else joined.drop("__bucket")
    return found.filter((F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def carried(rows: DataFrame, keys: list[str], at: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with each value replaced by the largest so far, in the order (at, *order) within the keys.

    Two levels: the largest of every month, carried over months (a calendar's worth of rows a key), then a running
    maximum inside the month. No task holds all rows of a key.
    """
    month = rows.withColumn("__month", F.trunc(at, "MM"))
    tops = month.groupBy(*keys, "__month").agg(*[F.max(v).alias(f"__top_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*keys, "__month", *[F.max(f"__top_{v}").over(earlier).alias(f"__before_{v}") for v in values])
    inside = Window.partitionBy(*keys, "__month").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = month.join(before, [*keys, "__month"])
    return joined.withColumns({v: F.greatest(F.max(v).over(inside), F.col(f"__before_{v}")) for v in values}).drop("__month", *[f"__before_{v}" for v in values])
