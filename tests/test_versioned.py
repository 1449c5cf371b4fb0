"""Versioned tables: what each version holds, crashes before a commit, races, conflicts, replays and slices."""

import uuid

import pytest
from pyspark.sql import functions as F
from retrospect.sources.scratch import scratch_dir
from retrospect.sources.versioned import ConflictError, LostRaceError, VersionedTable

SHAPE = "k long, part string, v string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def _table(spark, rows=(), **settings):
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    table = VersionedTable.create(spark, path, _rows(spark, []).schema, ["k"], **{"buckets": 4, **settings})
    if rows:
        table.replace_slices(_rows(spark, rows)) if settings.get("slice_column") else table.insert(_rows(spark, rows))
    return table


def _held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_versions_hold_what_was_committed(spark):
    table = _table(spark)
    assert _held(table) == [] and table.versions() == [0]
    assert table.insert(_rows(spark, [(1, "a", "x"), (2, "a", None)])) == 1
    assert table.upsert(_rows(spark, [(2, "b", "y"), (3, "b", "z")])) == 2
    assert table.insert(_rows(spark, [(3, "b", "z"), (4, "c", "w")])) == 3
    assert _held(table, 1) == [(1, "a", "x"), (2, "a", None)]
    assert _held(table, 2) == [(1, "a", "x"), (2, "b", "y"), (3, "b", "z")]
    assert _held(table) == [(1, "a", "x"), (2, "b", "y"), (3, "b", "z"), (4, "c", "w")]
    assert sorted(map(tuple, table.added(3).collect())) == [(4, "c", "w")]
    assert VersionedTable(spark, table.path).versions() == [0, 1, 2, 3]


def test_only_touched_parts_are_written(spark):
    table = _table(spark, [(i, "a", "x") for i in range(100)], buckets=16)
    table.upsert(_rows(spark, [(5, "a", "new")]))
    before, after = table.manifest(1), table.manifest(2)
    assert [p for p in after.parts if after.parts[p] != before.parts[p]] == after.changed and len(after.changed) == 1
    assert table.added(2).count() < 30 and len(_held(table)) == 100


def test_conflicts_refuse_the_whole_batch(spark):
    table = _table(spark, [(1, "a", None), (2, "a", "x")])
    with pytest.raises(ConflictError, match="differ"):
        table.insert(_rows(spark, [(1, "a", "now"), (9, "a", "x")]))
    with pytest.raises(ConflictError, match="twice"):
        table.upsert(_rows(spark, [(7, "a", "x"), (7, "a", "y")]))
    assert table.versions() == [0, 1] and len(_held(table)) == 2
    assert table.insert(_rows(spark, [(1, "a", None)])) == 2 and len(_held(table)) == 2


def test_a_crash_before_the_commit_leaves_no_trace_for_readers(spark, monkeypatch):
    table = _table(spark, [(1, "a", "x")])
    batch = _rows(spark, [(1, "a", "y"), (2, "a", "z")])

    def dies(manifest):
        raise OSError("lost")

    monkeypatch.setattr(table, "_publish", dies)
    with pytest.raises(OSError, match="lost"):
        table.upsert(batch)
    monkeypatch.undo()
    assert _held(table) == [(1, "a", "x")] and len(table.orphans()) == 1
    table.upsert(batch)
    assert _held(table) == [(1, "a", "y"), (2, "a", "z")] and len(table.orphans()) == 1


def _racing(table, act):
    """table, with `act` done by another writer between its work and its commit, once or in every attempt."""
    publish = table._publish

    def late(manifest):
        act()
        return publish(manifest)

    table._publish = late
    return table


def test_two_writers_of_other_parts_both_win(spark):
    table = _table(spark, [(i, f"s{i % 3}", "x") for i in range(9)], slice_column="part")
    other, once = VersionedTable(spark, table.path), [True]
    act = lambda: once and once.pop() and other.replace_slices(_rows(spark, [(50, "s1", "other")]))
    assert _racing(table, act).replace_slices(_rows(spark, [(60, "s2", "mine")])) == 3
    assert [r for r in _held(other) if r[1] != "s0"] == [(50, "s1", "other"), (60, "s2", "mine")]


def test_a_writer_that_lost_its_part_works_again_over_the_winner(spark):
    table = _table(spark, [(1, "a", "x"), (2, "a", "x")], buckets=1)
    other, once = VersionedTable(spark, table.path), [True]
    act = lambda: once and once.pop() and other.upsert(_rows(spark, [(2, "a", "other"), (3, "a", "other")]))
    assert _racing(table, act).upsert(_rows(spark, [(3, "a", "mine")])) == 3
    assert _held(other) == [(1, "a", "x"), (2, "a", "other"), (3, "a", "mine")]
    count = iter(range(100))
    with pytest.raises(LostRaceError):
        _racing(VersionedTable(spark, table.path), lambda: other.upsert(_rows(spark, [(9, "a", str(next(count)))]))).upsert(_rows(spark, [(1, "a", "mine")]))


def test_a_batch_given_again_changes_nothing(spark):
    table = _table(spark)
    for number, value in ((0, "a"), (1, "b"), (0, "a"), (1, "b")):
        table.upsert(_rows(spark, [(1, "p", value)]), batch_of=("w", number))
    assert table.versions() == [0, 1, 2] and _held(table) == [(1, "p", "b")]
    assert table.upsert(_rows(spark, [(1, "p", "c")]), batch_of=("other writer", 0)) == 3


def test_slices_are_replaced_and_emptied(spark):
    table = _table(spark, [(1, "a", "x"), (2, None, "x"), (3, "b/=%", "x")], slice_column="part")
    table.replace_slices(_rows(spark, [(4, None, "y")]), emptied=spark.createDataFrame([("b/=%",)], "part string"))
    assert _held(table) == [(1, "a", "x"), (4, None, "y")] and len(_held(table, 1)) == 3
    with pytest.raises(ValueError, match="slice column"):
        _table(spark).replace_slices(_rows(spark, []))


def test_append_new_passes_over_known_keys(spark):
    table = _table(spark, [(1, "a", "x")])
    table.append_new(_rows(spark, [(1, "a", "other"), (2, "a", "y"), (2, "a", "y")]))
    assert _held(table) == [(1, "a", "x"), (2, "a", "y")]
    assert table.read().filter(F.col("k") == 2).count() == 1
