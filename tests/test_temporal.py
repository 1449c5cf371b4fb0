"""Snapshot rules on literal rows, and the two leap-year rules."""

import datetime

from pyspark.sql import functions as F
from retrospect.operators import temporal as t

#: The demo's versions, cutoffs and the snapshot that they give.
VERSIONS = [
    ("DEMO_UNRATE", "2023-12-01", "2024-01-05", "9999-12-31", 3.7),
    ("DEMO_UNRATE", "2024-02-01", "2024-03-08", "9999-12-31", 3.9),
    ("DEMO_PAYEMS", "2023-12-01", "2024-01-05", "2024-02-01", 216.0),
    ("DEMO_PAYEMS", "2023-12-01", "2024-02-02", "9999-12-31", 229.0),
    ("DEMO_PAYEMS", "2024-01-01", "2024-02-02", "2024-03-07", 353.0),
    ("DEMO_PAYEMS", "2024-01-01", "2024-03-08", "9999-12-31", 290.0),
    ("DEMO_CORE_PCE", "2023-12-01", "2024-01-26", "9999-12-31", 2.9),
    ("DEMO_CORE_PCE", "2024-01-01", "2024-02-29", "9999-12-31", 2.8),
    ("DEMO_REAL_GDP", "2023-10-01", "2024-01-25", "2024-02-27", 3.3),
    ("DEMO_REAL_GDP", "2023-10-01", "2024-02-28", "2024-03-27", 3.2),
    ("DEMO_REAL_GDP", "2023-10-01", "2024-03-28", "9999-12-31", 3.4),
]
CUTOFFS = [("FOMC-2024-01", "2024-01-30"), ("FOMC-2024-03", "2024-03-19")]
EXPECTED = {
    ("FOMC-2024-01", "DEMO_UNRATE", "2023-12-01", "2024-01-05"),
    ("FOMC-2024-01", "DEMO_PAYEMS", "2023-12-01", "2024-01-05"),
    ("FOMC-2024-01", "DEMO_CORE_PCE", "2023-12-01", "2024-01-26"),
    ("FOMC-2024-01", "DEMO_REAL_GDP", "2023-10-01", "2024-01-25"),
    ("FOMC-2024-03", "DEMO_UNRATE", "2024-02-01", "2024-03-08"),
    ("FOMC-2024-03", "DEMO_PAYEMS", "2024-01-01", "2024-03-08"),
    ("FOMC-2024-03", "DEMO_CORE_PCE", "2024-01-01", "2024-02-29"),
    ("FOMC-2024-03", "DEMO_REAL_GDP", "2023-10-01", "2024-02-28"),
}


def _tables(spark):
    versions = spark.createDataFrame(VERSIONS, "series_id string, o string, s string, e string, value double").select(
        "series_id", F.to_date("o").alias("observation_date"), F.to_date("s").alias("realtime_start"), F.to_date("e").alias("realtime_end"), "value"
    )
    return versions, spark.createDataFrame(CUTOFFS, "meeting_id string, c string").select("meeting_id", F.to_date("c").alias("cutoff"))


def test_demo_snapshot(spark):
    versions, cutoffs = _tables(spark)
    rows = t.snapshot(versions, cutoffs, {}, 1)
    assert {(r.meeting_id, r.series_id, str(r.observation_date), str(r.realtime_start)) for r in rows.collect()} == EXPECTED
    assert sorted(r.n_rows for r in t.leakage(t.snapshot(versions, cutoffs, {}, 100)).collect()) == [4, 7]
    assert all(r.n_leaks == 0 for r in t.leakage(rows).collect())


def test_as_of_plans_agree(spark):
    versions, cutoffs = _tables(spark)
    names = ["meeting_id", "series_id", "observation_date", "realtime_start", "value"]
    a, b = (sorted(map(tuple, x(versions, cutoffs).select(*names).collect())) for x in (t.as_of_join, t.as_of_union))
    assert a == b and {(r[0], r[1], str(r[2]), str(r[3])) for r in a} == EXPECTED


def test_leap_years(spark):
    days = spark.createDataFrame([(datetime.date(2024, 2, 29),), (datetime.date(2024, 3, 1),)], "day date")
    strict = dict(map(tuple, t.year_ago_strict(days).collect()))
    clamped = dict(map(tuple, t.year_ago_clamped(days).collect()))
    assert strict[datetime.date(2024, 2, 29)] is None and clamped[datetime.date(2024, 2, 29)] == datetime.date(2023, 2, 28)
    assert strict[datetime.date(2024, 3, 1)] == clamped[datetime.date(2024, 3, 1)] == datetime.date(2023, 3, 1)
