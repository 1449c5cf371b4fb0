"""Excerpt repair, whole-text repair and vote clauses against literal cases."""

from difflib import SequenceMatcher

from retrospect.functions.repair import cleaned_text, repaired_text
from retrospect.operators import minutes, traces


def test_excerpts(spark):
    unit = " ".join(f"word{i}" for i in range(400))
    hint = "word120 word121 word122 word123 word124 XYZ word126 word127"
    rows = [(1, "word3 word4", unit), (2, "nothing like it", "a short unit"), (3, hint, unit), (4, "zzz", unit), (5, "x", None)]
    found = {r.key: (r.tier, r.excerpt) for r in traces.repaired_excerpts(spark, spark.createDataFrame(rows, "key int, hint string, unit string")).collect()}
    at = SequenceMatcher(None, hint, unit, autojunk=False).find_longest_match().b
    assert found[1] == ("EXACT", "word3 word4") and found[2] == ("UNIT", "a short unit")
    assert found[3] == ("ANCHOR", unit[at - 350 : at + 550]) and found[4] == ("KEPT", "zzz") and found[5][0] == "KEPT"


def test_text_repair():
    broken = "a–b".encode().decode("latin-1")
    assert repaired_text(broken) == "a–b" and repaired_text(None) is None
    assert cleaned_text(f" {broken}  ﬁne… ") == "a-b fine..."
    four = "\U0001f600".encode().decode("latin-1")
    assert repaired_text(four + "\u0080") == "\U0001f600\u0080"  # a stray letter after a whole run


def test_vote_clauses(spark):
    papers = [
        ("a", ["Voting for this action: Messrs. Lee, Ray, and Poe. Votes against this action: Ms. Fox, who preferred no change."]),
        ("b", ["Voting against this action: Ann Lee.", "Voting for this action: Bo B. Ray and Cy Poe Jr."]),
        ("c", ["Voting for this action: Ann Lee, Ann Lee."]), ("d", ["No vote was taken."]), ("e", ["Voting for the other thing: Ann Lee."]),
    ]
    found = {(r.document, r.problem): (r.voted_for, r.voted_against, r.explicit) for r in minutes.vote_rounds(spark.createDataFrame(papers, "document string, paragraphs array<string>")).collect()}
    assert found["a", None] == (["Lee", "Ray", "Poe"], ["Fox"], True)
    assert found["b", None] == (["Bo B. Ray", "Cy Poe Jr"], [], False) and ("b", "AGAINST_FIRST") in found
    assert ("c", "DUPLICATE") in found and ("d", "NO_VOTE") in found and ("e", "UNREADABLE") in found


def test_the_queue_parses_traces_once(spark):
    from retrospect.plans import catalog

    plan = catalog.QUERIES["b12_review_queue"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "to_json" not in plan


def test_locators_outside_a_text(spark):
    from retrospect.operators.records import located

    docs = spark.createDataFrame([("d", "one\ntwo"), ("n", None)], "doc_id string, text string")
    asked = [("d", "paragraph 2", "two"), ("d", "paragraph 3", "two"), ("d", "paragraph 0", "one"), ("d", "page 1", "one"), ("n", "paragraph 1", "x"), ("gone", "paragraph 1", "x")]
    found = located(spark.createDataFrame(asked, "doc_id string, locator string, excerpt string"), docs).collect()
    assert {(r.doc_id, r.locator): (r.unit, r.found) for r in found} == {a[:2]: (("two", True) if a == asked[0] else (None, False)) for a in asked}


def test_a_forecast_is_made_once(spark):
    from retrospect.plans import catalog

    plan = catalog.QUERIES["b05_forward_bundles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") <= 2, plan.count("orders.parquet")


def test_parts_of_a_bundle_from_its_own_row(spark):
    from pyspark.sql import functions as F
    from retrospect.operators import traces as tr

    cases = spark.createDataFrame([("a", 1, [("p2", "FOR"), ("p1", "AGAINST")]), ("b", 2, None)], "case string, n int, voters array<struct<participant: string, vote: string>>")
    cards = spark.createDataFrame([("a", "x", 1)], "case string, card string, k int")
    voters = cases.select("case", F.explode("voters").alias("v")).select("case", "v.*")
    joined = tr.case_bundles(cases.select("case", "n"), {"voters_too": voters, "cards": cards})
    own = tr.case_bundles(cases, {"voters_too": F.col("voters"), "cards": cards}, ("voters",))
    assert own.columns == joined.columns and sorted(own.collect()) == sorted(joined.collect())


def test_predictions_are_counted_in_their_case(spark):
    from retrospect.operators import traces as tr

    votes = {1: "AGAINST", 2: "FOR"}
    made = [("a", 1, "CUT", votes), ("a", 2, "HOLD", votes), ("a", 3, "CUT", votes), ("a", 4, "HOLD", votes), ("b", 1, "HIKE", {1: "FOR"}), ("c", 1, "CUT", votes), ("c", 1, "CUT", votes), ("c", None, "CUT", None), ("e", 1, "CUT", votes)]
    predictions = spark.createDataFrame(made, "case string, model int, action string, votes map<bigint,string>")
    roster = spark.createDataFrame([(c, p) for c in "abcd" for p in (2, 1, 1)], "case string, participant bigint")
    fallback = spark.createDataFrame([(c, "HOLD") for c in "abcd"], "case string, fallback string")
    found = {r.case: (r.action, r.support, r.models, r.consensus, [(v.participant, v.against_support, v.vote) for v in r.votes], r.problem) for r in tr.combined_forecast(predictions, roster, fallback, policy_support=2).collect()}
    assert found == {
        "a": ("CUT", 2, 4, True, [(1, 4, "AGAINST"), (2, 0, "FOR")], None), "b": ("HOLD", 1, 1, False, [(1, 0, "FOR"), (2, 0, "FOR")], "COVERAGE"),
        "c": ("CUT", 3, 3, True, [(1, 2, "AGAINST"), (2, 0, "FOR")], "DUPLICATE_MODEL"), "d": ("HOLD", 0, 0, False, [(1, 0, "FOR"), (2, 0, "FOR")], "NO_MODEL"),
    }
