"""Members' evidence against the rule applied to each ask alone."""

import random
from datetime import date, timedelta

import pytest
from retrospect.operators.evidence import SPEECH, member_evidence


def _rule(asks, segments, speeches, limit):
    rows = set()
    for meeting, who, cutoff in asks:
        turns = [r for r in segments if r[0] == who and r[1] != meeting and r[4][:10] <= cutoff.isoformat()]
        turns = sorted(turns, key=lambda r: (r[4], r[1], r[3], r[2]), reverse=True)[: 2 * limit]
        found = [(p, d, f"transcript segment {n}") for _, _, d, n, p in turns]
        found += [(p, d, SPEECH) for w, d, p, score in speeches if w == who and score > 0 and p[:10] <= cutoff.isoformat()]
        rows |= {(meeting, who, i + 1, *f) for i, f in enumerate(sorted(found, reverse=True)[:limit])}
    return rows


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_drawn(spark, limit):
    drawn = random.Random(limit)
    day = lambda: date(2020, 1, 1) + timedelta(drawn.randint(0, 90))
    stamp = lambda: f"{day().isoformat()}T{drawn.choice(['08', '20'])}:00:00Z"
    sittings = [(f"m{drawn.randint(1, 12)}", stamp()) for _ in range(20)]
    segments = {(f"p{drawn.randint(1, 4)}", m, f"{m}-{p}", drawn.randint(0, 12), p) for m, p in drawn.choices(sittings, k=150)}
    segments = [r for r in segments if r[0] != "p4"]
    speeches = [(f"p{drawn.randint(1, 4)}", f"s{i}", stamp(), drawn.randint(0, 2)) for i in range(40)]
    asks = list({(f"m{drawn.randint(1, 13)}", f"p{drawn.randint(1, 5)}"): None for _ in range(60)})
    asks = [(*a, day()) for a in asks]
    make = spark.createDataFrame
    found = member_evidence(
        make([*asks, ("m1", None, day())], "meeting string, participant string, cutoff date"),
        make([*segments, (None, "m1", "x", 0, "2020-01-01"), ("p1", None, "x", 0, "2020-01-01"), ("p1", "m1", "x", 0, None)], "participant string, meeting string, document_id string, ordinal int, published string"),
        make([*speeches, (None, "s", "2020-01-01", 1), ("p1", "s", None, 1), ("p1", "s", "2020-01-01", None)], "participant string, document_id string, published string, score int"), limit,
    )
    assert {(r.meeting, r.participant, r.rank, r.published, r.document_id, r.locator) for r in found.collect()} == _rule(asks, segments, speeches, limit)


def test_empty(spark):
    asks = spark.createDataFrame([("m", "p", date(2020, 1, 1))], "meeting string, participant string, cutoff date")
    segments = spark.createDataFrame([], "participant string, meeting string, document_id string, ordinal int, published string")
    speeches = spark.createDataFrame([("p", "s", "2020-01-01T00:00:00Z", 3)], "participant string, document_id string, published string, score int")
    assert [tuple(r) for r in member_evidence(asks, segments, speeches).collect()] == [("m", "p", "public_communication", "s", SPEECH, "2020-01-01T00:00:00Z", 1)]
    assert member_evidence(asks.limit(0), segments, speeches).count() == 0


def test_matches_are_ranked_where_they_meet(spark):
    from retrospect.plans import catalog

    plan = catalog.QUERIES["o05_member_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(meeting" not in plan and "Exchange hashpartitioning(participant" in plan
    assert sum("Exchange hashpartitioning" in line and "published" in line for line in plan.splitlines()) == 0


def test_many_sittings_of_one_meeting(spark):
    segments = [("p", "m", f"m-{i}", 0, f"2020-01-{i + 2:02d}T00:00:00Z") for i in range(20)] + [("p", "n", "n-0", 0, "2020-01-01T00:00:00Z"), ("p", "n", "n-0", 1, "2020-01-01T00:00:00Z")]
    asks = [("m", "p", date(2020, 3, 1)), ("x", "p", date(2020, 3, 1)), ("x", "p", date(2020, 1, 3))]
    speeches = [("p", "s", "2020-01-01T00:00:00Z", 1)]
    make = spark.createDataFrame
    found = member_evidence(
        make(asks, "meeting string, participant string, cutoff date"), make(segments, "participant string, meeting string, document_id string, ordinal int, published string"),
        make(speeches, "participant string, document_id string, published string, score int"), 1,
    )
    assert sorted((r.meeting, r.document_id, r.locator) for r in found.collect()) == [("m", "s", SPEECH), ("x", "m-1", "transcript segment 0"), ("x", "m-19", "transcript segment 0")]
