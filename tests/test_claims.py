"""Monitor lint on literal claims."""

import pytest
from retrospect.functions import claims
from retrospect.operators import records

F = claims.FAULTS
SERIES = [("CPIAUCSL", "Index"), ("UNRATE", "Percent"), ("T5YIFR", None), ("PAYEMS", "thousands of persons"), ("GDP", " Billions of dollars")]
CASES = [
    (("UNRATE", "Unemployment stays\nbelow 4.5", "LT", 4.5, "level"), []),
    (("NOPE", "between 1 and 2", "GT", 0.0, "level"), [claims.NO_SERIES]),
    ((None, "x", "GT", 0.0, "level"), [claims.NO_SERIES]),
    (("CPIAUCSL", "CPI above 3", "GT", 3.0, "level_v1"), [F["yoy"]]),
    (("CPIAUCSL", "CPI above 3", "GT", 3.0, "CPI_YOY_v1"), []),
    (("GDP", "Output grows", "gte", 0.0, "level"), [F["tautology"]]),
    (("GDP", "Output grows", "GT", 0.5, "level"), []),
    (("GDP", "Output grows", "LT", 0.0, "level"), []),
    (("GDP", "Output grows", None, None, None), []),
    (("GDP", "Between 2% and 3", "LT", 1.0, "level"), [F["range"]]),
    (("GDP", "2.5 percent – 3 of it", "LT", 1.0, "level"), [F["range"]]),
    (("GDP", "between two and 3", "LT", 1.0, "level"), []),
    (("GDP", "around a target of roughly 2", "LT", 1.0, "level"), [F["range"]]),
    (("GDP", "around " + "x" * 31 + " 2", "LT", 1.0, "level"), []),
    (("UNRATE", "prices fall", "LT", 1.0, "level"), [F["compound"]]),
    (("UNRATE", "priced in", "LT", 1.0, "level"), []),
    (("T5YIFR", "PAYROLL growth", "LT", 1.0, "level"), [F["compound"]]),
    (("GDP", "SUBJECT   TO review", "LT", 1.0, "level"), [F["compound"]]),
    (("GDP", "Increases at first and then holds", "LT", 1.0, "level"), [F["path"]]),
    (("GDP", "then slowly declining", "LT", 1.0, "level"), [F["path"]]),
    (("GDP", "continued to fall", "LT", 1.0, "level"), [F["path"]]),
    (("GDP", "athenian decline", "LT", 1.0, "level"), []),
    (("GDP", None, "LT", 1.0, "level"), []),
    (("CPIAUCSL", "Jobs: 1 to 2, followed by 3", "GT", 0.0, None), [F["yoy"], F["range"], F["compound"], F["path"]]),
]


def test_faults(spark):
    rows = [(i, *given) for i, (given, _) in enumerate(CASES)]
    names = "id int, monitor_series_id string, claim string, monitor_operator string, threshold_value double, monitor_rule_version string"
    found = records.linted(spark.createDataFrame(rows, names), spark.createDataFrame(SERIES, "series_id string, units string"))
    assert {r.id: r.faults for r in found.collect()} == {i: expected for i, (_, expected) in enumerate(CASES)}


@pytest.mark.parametrize("rows", [[], [("UNRATE", None, None, None, None)]])
def test_empty_and_null(spark, rows):
    names = "monitor_series_id string, claim string, monitor_operator string, threshold_value double, monitor_rule_version string"
    found = records.linted(spark.createDataFrame(rows, names), spark.createDataFrame(SERIES, "series_id string, units string"))
    assert [r.faults for r in found.collect()] == [[] for _ in rows]
