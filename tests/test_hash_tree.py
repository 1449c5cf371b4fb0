"""Roots and differences of hash trees against plain sets of rows."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F
from retrospect.operators import hash_tree as ht
from retrospect.sources.scratch import scratch_dir

SCHEMA = "key int, value string"


def _tree(spark, rows, levels):
    frame = spark.createDataFrame(rows, SCHEMA)
    return ht.write_tree(frame, ["key"], ["key", "value"], f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex}", levels)


def _brute(old, new):
    keys = {k for k, _ in old} | {k for k, _ in new}
    out = {}
    for key in keys:
        was, now = (sorted((v for k, v in rows if k == key), key=repr) for rows in (old, new))
        gained = any(now.count(v) > was.count(v) for v in now)
        lost = any(was.count(v) > now.count(v) for v in was)
        if gained or lost:
            out[key] = "CHANGED" if gained and lost else "ADDED" if gained else "REMOVED"
    return out


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_differences(spark, levels, monkeypatch):
    if levels == 1:
        monkeypatch.setattr(ht, "PUSHED", 3)  # more nodes differ than are named in a scan
    draw = random.Random(levels)
    old = [(i, draw.choice(["", "a", None, "a|b"])) for i in range(300)] + [(None, "x"), (7, "more"), (7, "more")]
    new = [(k, "new" if draw.random() < 0.05 else v) for k, v in old if draw.random() > 0.05] + [(900, "y"), (7, "more"), (None, None)]
    found = ht.tree_diff(spark, _tree(spark, old, levels), _tree(spark, new, levels)).collect()
    assert {r.key: r.change for r in found} == _brute(old, new)
    assert len(found) == len(_brute(old, new))


def test_root_is_of_the_rows_alone(spark):
    rows = [(i % 50, f"v{i % 70}") for i in range(500)]
    a = _tree(spark, rows, 1)
    random.Random(3).shuffle(rows)
    path = f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex}"
    b = ht.write_tree(spark.createDataFrame(rows, SCHEMA).repartition(11, "value"), ["key"], ["key", "value"], path, 1)
    assert a.root(spark) == b.root(spark) is not None
    assert ht.tree_diff(spark, a, b).count() == 0
    assert a.root(spark) != _tree(spark, rows[1:], 1).root(spark)


def test_nulls_are_not_texts(spark):
    one = lambda v: spark.createDataFrame([v], "a string, b string").select(ht.fingerprint(["a", "b"]).alias("f")).first().f
    assert len({one((None, "")), one(("", None)), one(("-", "")), one(("|", "")), one(("", "|")), one((None, None))}) == 6


def test_empty_tables(spark):
    empty, full = _tree(spark, [], 1), _tree(spark, [(1, "a"), (2, None)], 1)
    assert empty.root(spark) is None
    assert ht.tree_diff(spark, empty, empty).count() == 0
    assert {(r.key, r.change) for r in ht.tree_diff(spark, empty, full).collect()} == {(1, "ADDED"), (2, "ADDED")}
    assert ht.roots(spark.createDataFrame([], SCHEMA), ["key", "value"], "value", 1).count() == 0


def test_equal_parts_are_not_read(spark):
    rows = spark.range(20_000).select(F.col("id").cast("int").alias("key"), F.lit("v").alias("value"))
    base = f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex}"
    levels = ht.levels_for(20_000)
    assert levels == 1
    old = ht.write_tree(rows, ["key"], ["key", "value"], f"{base}/old", levels)
    new = ht.write_tree(rows.filter("key <> 77"), ["key"], ["key", "value"], f"{base}/new", levels)
    diff = ht.tree_diff(spark, old, new)
    assert [tuple(r) for r in diff.collect()] == [(77, "REMOVED")]
    plan = ht.tree_diff(spark, old, new)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*part#\d+ = x[0-9a-f]{2}", plan)) == 2


def test_hot_rows_are_one_entry(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("int").alias("key"), F.lit("v").alias("value"))
    found = ht.entries(rows, ["key", "value"], ["key"])
    assert found.agg(F.max("copies")).first()[0] == 10_001
    assert found.count() == rows.distinct().count()
