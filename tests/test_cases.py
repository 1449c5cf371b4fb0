from datetime import date

from pyspark.sql import functions as F
from retrospect.operators import cases


def test_flip_needs_support_before_it(spark):
    rows = [("a", 1, 1, True, False), ("a", 2, 2, False, True), ("b", 2, 1, False, True), ("b", 2, 2, True, False), ("c", 1, 1, True, True), ("d", 0, 1, True, False), ("d", 2, 2, False, True)]
    statements = spark.createDataFrame(rows, "claim string, at int, id int, support boolean, flip boolean")
    claims = spark.createDataFrame([(c, 1, 2) for c in "abcde"], "claim string, adopted_at int, contradiction_at int")
    found = {r.claim: (r.flip_at, r.flip_id, r.status) for r in cases.first_phrase_flip(statements, claims).collect()}
    assert found["a"] == (2, 2, "OBSERVED")
    assert found["b"] == (2, 1, "NO_SUPPORT_BEFORE")  # support of the same day, but later in order
    assert found["c"] == found["e"] == (None, None, "NO_STATEMENT_FLIP")
    assert found["d"] == (2, 2, "NO_SUPPORT_BEFORE")  # support before adoption does not count


def test_response_on_the_day_counts(spark):
    flips = spark.createDataFrame([("x", date(2021, 12, 15), "HAWKISH"), ("y", date(2021, 12, 15), "DOVISH")], "desk string, flip_at date, direction string")
    rows = [("x", 2, date(2022, 3, 16), "HIKE"), ("x", 1, date(2021, 12, 15), "CUT"), ("x", 3, date(2022, 5, 4), "HIKE"), ("y", 4, date(2021, 12, 15), "CUT")]
    found = cases.first_response(flips, spark.createDataFrame(rows, "desk string, meeting int, decided_on date, action string"), "desk")
    assert {r.desk: r.response_meeting for r in found.collect()} == {"x": 2, "y": 4}


def test_names_with_one_first_name_only(spark):
    names = spark.createDataFrame([(n,) for n in ("Ann Lee", "Ann B Lee", "Lee", "Bo Ray", "Cy Ray", None)], "name string")
    assert [tuple(r) for r in cases.full_names(names).collect()] == [("Lee", "Ann B Lee")]


def test_attribution(spark):
    items = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "item int, participant int")
    references = spark.createDataFrame([(1, 7, True), (1, 8, True), (1, None, False), (2, 8, True), (2, None, False)], "item int, owner int, known boolean")
    found = {r["item"]: (r["participant"], r["kept"], r["demoted"]) for r in cases.repaired_attribution(items, references).collect()}
    assert found == {1: (7, 2, False), 2: (None, 2, True), 3: (None, 0, True)}


def test_no_references(spark):
    one = F.expr("cast(null as array<struct<document_id: int>>)")
    part = F.expr("cast(null as array<struct<evidence_refs: array<struct<document_id: int>>>>)")
    held = F.struct(one.alias("evidence_refs"))
    empty = spark.range(1).select("id", held.alias("context"), part.alias("options"), part.alias("debate"), held.alias("decision"), F.struct(part.alias("rounds")).alias("vote"), part.alias("assumptions"))
    assert cases.evidence_references(empty, "id").count() == 0
