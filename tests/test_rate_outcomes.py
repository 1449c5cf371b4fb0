"""Rate outcomes over the change from a target to a range."""

from datetime import date

from retrospect.operators.evaluation import rate_outcomes


def _day(n):
    return date(2008, 12, n)


def test_before_across_and_after(spark):
    versions = [
        ("T", 1, 1, 1.0), ("T", 4, 4, 1.5), ("T", 4, 6, 1.25), ("T", 5, 5, None), ("T", 12, 12, 9.0), ("L", 16, 16, 0.0), ("U", 17, 17, 0.25), ("L", 17, 17, 0.0), ("L", 17, 30, 0.25), ("L", 22, 22, 0.5), ("U", 22, 22, 0.5), ("X", 2, 2, 7.0),
    ]
    rows = spark.createDataFrame([(s, _day(a), _day(r), v) for s, a, r, v in versions], "series_id string, observation_date date, realtime_start date, value double")
    meetings = [("early", 2, 3), ("none", 1, 13), ("across", 15, 16), ("late", 17, 18), ("last", 23, 24)]
    meetings = spark.createDataFrame([(m, _day(c), _day(e)) for m, c, e in meetings], "meeting_id string, cutoff date, ended date")
    found = {r.meeting_id: r for r in rate_outcomes(meetings, rows, "2008-12-16", "T", "L", "U").collect()}
    assert (found["early"].action, found["early"].pre_target, found["early"].post_target, found["early"].effective) == ("HIKE", 1.0, 1.25, _day(4))  # the newest version
    assert (found["none"].action, found["none"].pre_target, found["none"].effective) == (None, 1.0, None)
    assert (found["across"].action, found["across"].pre_target, found["across"].post_lower, found["across"].effective) == ("CUT", 9.0, 0.25, _day(17))  # the 16th has no upper value
    assert (found["late"].action, found["late"].pre_target, found["late"].pre_lower, found["late"].pre_upper, found["late"].effective) == ("HIKE", None, 0.0, 0.25, _day(22))
    assert found["last"].action is None and found["last"].pre_lower == 0.5
    assert rate_outcomes(meetings.limit(0), rows, "2008-12-16", "T", "L", "U").count() == 0
