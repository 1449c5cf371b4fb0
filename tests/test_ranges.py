"""Running states over ranges against a plain loop over rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from retrospect.operators import temporal as t
from retrospect.operators.ranges import RANGE, ranged, with_earlier


def _brute(rows):
    total, last, out = defaultdict(int), {}, set()
    for key, at, value in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out.add((key, at, value, total[key], last.get(key)))
        total[key] += value or 0
        if value is not None:
            last[key] = value
    return out


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_totals_and_lasts(spark, hot):
    draw = random.Random(int(hot * 10))
    rows = []
    for i in range(3000):
        key = "hot" if draw.random() < hot else draw.choice([None, "", *(f"k{j}" for j in range(40))])
        rows.append((key, None if i == 0 else i, draw.choice([None, 0, 1, 2, 3])))
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "key string, at int, value int").repartition(7)
    found = with_earlier(ranged(frame, ["key"], ["at"]), ["key"], ["at"], {"total": F.col("value")}, {"last": F.col("value")})
    assert {tuple(r) for r in found.select("key", "at", "value", "total", "last").collect()} == _brute(rows)


def test_a_single_series_lies_in_all_ranges(spark):
    rows = spark.range(200_000).select(F.lit("one").alias("series_id"), F.col("id").alias("day"), F.floor(F.col("id") / 1000).alias("level"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ranged(rows, ["series_id"], ["day"]).groupBy(RANGE).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) < 0.5 * sum(sizes)
    assert [r.day for r in t.change_points(rows).orderBy("day").collect()] == list(range(0, 200_000, 1000))


def test_only_one_state_reaches_a_range(spark):
    rows = spark.range(50_000).select((F.col("id") % 500).alias("key"), F.col("id").alias("at"))
    spread = ranged(rows, ["key"], ["at"]).select("key", RANGE).distinct()
    begun = spread.groupBy("key").agg(F.min(RANGE).alias("first"))
    carried = spread.join(begun, "key").filter(F.col(RANGE) > F.col("first")).groupBy(RANGE).count()
    assert all(r["count"] == 1 for r in carried.collect())


def test_empty_tables_stay_empty(spark):
    empty = spark.createDataFrame([], "series_id string, day date, level double")
    assert t.regime_starts(t.directions(t.change_points(empty)), 1.0).count() == 0
    assert t.prior_history(spark.createDataFrame([], "meeting int, participant int, dissent boolean")).count() == 0


def test_levels_that_are_null(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, 1.0), ("a", 4, None)], "series_id string, day int, level double")
    assert [(r.day, r.level) for r in t.change_points(rows).orderBy("day").collect()] == [(1, None), (3, 1.0), (4, None)]
