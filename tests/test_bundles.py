"""Trace bundles, locators in them and complete sets of documents on literal cases."""

import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from retrospect.operators import bundles as b

TEXT = {"statement": "<p>One  para.</p><p> </p><p>Two &amp; more</p>", "minutes": "<p>Held</p>", "transcript": "scan"}


def _hash(text):
    return sha256(text.encode()).hexdigest()


def _tables(spark, changes=()):
    documents = [["m1", f"d-{t}", t, b.USAGE[t], TEXT[t], _hash(TEXT[t])] for t in TEXT]
    for row, column, value in changes:
        documents[row][column] = value
    segments = [("d-transcript", 1, "B", "p2", "second", _hash("second")), ("d-transcript", 0, "A", None, "first  turn", _hash("first  turn")), ("d-gone", 0, "A", "p1", "x", "bad")]
    make = spark.createDataFrame
    return {
        "meetings": make([("m1",), ("m2",)], "meeting string"),
        "documents": make(documents, "meeting string, document_id string, document_type string, usage_class string, content string, content_hash string"),
        "segments": make(segments, "document_id string, ordinal int, speaker_label string, participant_id string, text string, content_hash string"),
        "roster": make([("m1", "p1", "Zed", "x", True, False), ("m1", "p2", "Ann", "x", False, False), ("m1", "p3", "Yan", "x", True, True), (None, "p4", "No", "x", True, False)], "meeting string, participant_id string, display_name string, role string, is_voter boolean, is_chair boolean"),
        "outcomes": make([("m1", "CUT", 1.0, None, None)], "meeting string, action_class string, target_rate double, target_lower double, target_upper double"),
        "votes": make([("m1", 2, "FOR"), ("m1", 1, "AGAINST"), ("m1", 1, "FOR"), ("m1", 1, None)], "meeting string, vote_round int, voter_choice string"),
        "series": make([("B", "b", "u"), ("A", None, "u")], "series_id string, title string, units string"),
        "sparse": make([("m2",)], "meeting string"),
    }


def test_a_whole_bundle(spark):
    accepted, refused = b.trace_bundles(**_tables(spark), n_series=2)
    row = accepted.first()
    assert [(d.document_type, [(p.ordinal, p.text) for p in d.paragraphs or []], [(x.ordinal, x.text) for x in d.segments or []]) for d in row.documents] == [
        ("statement", [(1, "One para."), (2, "Two & more")], []), ("minutes", [(1, "Held")], []), ("transcript", [], [(0, "first  turn"), (1, "second")]),
    ]
    assert [p.display_name for p in row.participants] == ["Yan", "Zed", "Ann"]
    assert [(r.vote_round, r.for_count, r.against_count) for r in row.vote_rounds] == [(1, 1, 1), (2, 1, 0)]
    assert [m.series_id for m in row.monitor_series] == ["A", "B"] and row.outcome.action_class == "CUT" and not row.sparse_minutes
    assert {r.meeting: r.problems for r in refused.collect()} == {"m2": ["MISSING_DOCUMENT", "NO_ROSTER", "NO_OUTCOME", "NO_VOTES"]}
    references = [
        ("m1", "d-transcript", " transcript segment 00 ", "first turn", True), ("m1", "d-transcript", "transcript segment 2", "x", False), ("m1", "d-transcript", "paragraph 1", "first", False),
        ("m1", "d-statement", "paragraph 2", "Two", True), ("m1", "d-statement", "paragraph 0", "One", False), ("m1", "d-statement", None, "One", False), ("m1", "d-minutes", "paragraph 1", None, False), ("m9", "d-x", "paragraph 1", "x", False),
    ]
    asked = spark.createDataFrame([(*r[:4], i) for i, r in enumerate(references)], "meeting string, document_id string, locator string, excerpt string, text int")
    assert {r.text: r.found for r in b.located_in_bundles(asked, accepted).collect()} == {i: r[4] for i, r in enumerate(references)}
    again = b.trace_bundles(**_tables(spark), n_series=2)[0].first()
    assert json.dumps(again.asDict(True)) == json.dumps(row.asDict(True))


@pytest.mark.parametrize(("change", "problem"), [
    ((0, 5, "bad"), ["HASH"]), ((0, 4, None), ["HASH", "NO_UNITS"]), ((2, 3, "label_only"), ["USAGE"]), ((1, 2, "statement"), ["REPEATED_DOCUMENT", "MINUTES"]), ((1, 2, "note"), ["MINUTES"]), ((2, 1, "d-gone"), ["SEGMENT_HASH"]),
])
def test_refused(spark, change, problem):
    accepted, refused = b.trace_bundles(**_tables(spark, [change]), n_series=2)
    assert refused.filter("meeting = 'm1'").first().problems == problem and accepted.count() == 0


def test_the_list_of_series_is_bounded(spark):
    with pytest.raises(ValueError, match="more than 1"):
        b.trace_bundles(**_tables(spark), n_series=1)


def test_complete_types(spark):
    make = lambda rows: spark.createDataFrame(rows, "meeting int, document_type string")
    documents = make([(1, "minutes"), (1, "statement"), (2, "statement"), (3, "statement"), (3, "statement"), (4, None), (5, "statement")])
    alone = spark.createDataFrame([(5, ["statement"])], "meeting int, required array<string>")
    overrides = make([(1, "minutes"), (2, "minutes"), (2, "minutes"), (9, "minutes")])
    found = b.document_completeness(spark.range(1, 6).selectExpr("cast(id as int) as meeting"), documents, ["statement", "minutes"], alone, overrides)
    assert {r.meeting: (r.types, r.overridden, r.complete) for r in found.collect()} == {
        1: (["minutes", "statement"], [], True), 2: (["minutes", "statement"], ["minutes"], True), 3: (["statement", "statement"], [], False), 4: ([], [], False), 5: (["statement"], [], True),
    }


def test_variants(spark):
    people = [("p-1", "Ann Lee", False), ("p-2", "Bo Ray", True)]
    cases = spark.createDataFrame([("m1", "2020-01-02", "h1", people), ("m2", "2020-02-02", "h2", people[:1]), ("m3", "2020-03-02", "h3", [])], "meeting string, meeting_date string, bundle_hash string, participants array<struct<participant_id: string, display_name: string, is_chair: boolean>>")
    evidence = spark.createDataFrame([("m1", 2, "p-2", "RAY said Lee left; Raymond"), ("m1", 1, "p-9", "nobody"), ("m1", 3, "p-1", None)], "meeting string, evidence_id int, participant_id string, text string")
    documents = spark.createDataFrame([("m1", "d", "Ann Lee met P-2"), ("m2", "d", "Bo Ray met Lee")], "meeting string, document_id string, text string")
    snapshot = spark.createDataFrame([("m1", "S", 1.5)], "meeting string, series_id string, value double")
    variants = [{"variant_id": "full", "participant_names": True, "persona_evidence": True}, {"variant_id": "blind", "economic_snapshot": True, "persona_evidence": True}, {"variant_id": "date", "meeting_date": True}]
    found = {(r.meeting, r.variant): r for r in b.variant_bundles(cases, evidence, documents, snapshot, variants).collect()}
    assert len(found) == 9 and len({r.case_id for r in found.values()}) == 9
    full, blind, date = (found["m1", v] for v in ("full", "blind", "date"))
    assert full.case_id == "case-" + _hash('{"bundle_hash":"h1","variant_id":"full"}')[:20]
    assert [tuple(p) for p in full.participants] == people and full.leaks == [] and full.snapshot == [] and full.meeting_date is None
    assert [(e.participant_id, e.text) for e in full.evidence] == [("p-2", "RAY said Lee left; Raymond"), ("p-1", None)]
    assert [p.participant_id for p in blind.participants] == ["participant-01", "chair-02"] and [p.display_name for p in blind.participants] == ["Participant 01", "Chair"]
    assert [e.text for e in blind.evidence] == ["[REDACTED_PARTICIPANT] said [REDACTED_PARTICIPANT] left; Raymond", None] and len(blind.snapshot) == 1
    assert blind.documents[0].text == "[REDACTED_PARTICIPANT] met P-2" and blind.leaks == ["p-2"]
    assert found["m2", "blind"].documents[0].text == "Bo Ray met [REDACTED_PARTICIPANT]" and found["m2", "blind"].leaks == []
    assert date.meeting_date == "2020-01-02" and date.participants == date.documents == date.evidence == [] and date.leaks == []
    assert found["m3", "blind"].documents == [] and found["m3", "blind"].participants == []


def test_parts_meet_by_meeting_only(spark):
    from retrospect.plans import catalog

    plans = [catalog.QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n in ("b02_trace_bundles", "b02_refused_meetings")]
    assert all("hashpartitioning(document_id" not in p and "bundle-documents" not in p for p in plans)
    assert all(p.count("ArrowEvalPython") == 1 for p in plans)


def test_segments_with_their_meeting(spark):
    tables = _tables(spark)
    segments = tables["segments"].selectExpr("*", "case when document_id = 'd-transcript' then 'm1' end as meeting")
    same, row = b.trace_bundles(**{**tables, "segments": segments}, n_series=2)[0].first(), b.trace_bundles(**tables, n_series=2)[0].first()
    assert same == row


def test_plain_pages_are_read_as_the_parser_reads_them(spark):
    from retrospect.functions import html

    pages = ["<html><p>A  b</p><p> </p>x", "<html><body><p>A \n b</p><p></p><p>c > d</p></body></html>", "<p>a &amp; b</p>", "<P>a<br>b</P><p>open", "", "<p>a</p><p>b"]
    table = spark.createDataFrame([(i, "", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    found = {r.page_id: r.t for r in table.select("page_id", html.paragraph_texts(spark, F.array("html"))[0].alias("t")).collect()}
    parsed = {i: [] for i in range(len(pages))}
    for r in html.paragraphs(table).orderBy("page_id", "ordinal").collect():
        parsed[r.page_id].append(r.text)
    assert found == parsed


def test_own_references_meet_no_other_bundles(spark):
    from retrospect.plans import catalog

    plan = catalog.QUERIES["j19_bundle_locators"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    accepted, _ = b.trace_bundles(**_tables(spark), n_series=2)
    asked = [("d-transcript", "transcript segment 0", "first turn", True), ("d-statement", "paragraph 2", "Two", True), ("d-statement", "paragraph 9", "Two", False), ("d-none", "paragraph 1", "x", False)]
    refs = F.array(*[F.struct(F.lit(d).alias("document_id"), F.lit(at).alias("locator"), F.lit(x).alias("excerpt")) for d, at, x, _ in asked])
    assert {(r.document_id, r.locator): r.found for r in b.located_in_own_bundles(accepted, refs).collect()} == {r[:2]: r[3] for r in asked}


def test_a_roster_is_redacted_in_its_case(spark):
    from retrospect.plans import catalog

    plan = catalog.QUERIES["b03_variant_bundles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "name-lists" not in plan
