"""Pages of minutes read in their own row: no parser for simple ones, no shuffle, the same votes and attendance."""

from pyspark.sql import functions as F
from retrospect.functions import html
from retrospect.operators import minutes as m
from retrospect.plans import catalog


def test_simple_pages_are_cut_as_the_parser_reads_them():
    pages = [
        "<html><body><p><strong>PRESENT:</strong><br>Ann  Lee, Chair<br/>Bo Ray</p>out<p>open<p>two</p></p><p>last", "<div><p>a<br />b</div>c</p><h2>d</h2>", "", "<p></p><br>x<p>y", "<table><tr><td>a</td></tr></table>tail",
        "<p>a</p><p>b > c</p>d<br>e</p>", "<p>a &amp; b</p>", "<P>a</P>", "<p class='x'>a</p>", "<p>a < b</p>", "<p>a<!-- x --></p>", "<script>if (a<p>b)</p></script><p>c</p>", "<p>a<p/>b</p>",
    ]
    read = html._paragraph_reader()
    for page in pages:
        for whole in (False, True):
            parser = html._extractor()()
            parser.feed(page)
            if whole:
                parser._flush()
            assert read(page, whole) == parser.done, page


def test_line_blocks_of_pages(spark):
    legacy = "<table><tr><td>PRESENT:</td></tr><tr><td>Mr. Lee, Chair<br>Mr. Poe</td></tr></table><p>Ann Ray, Alternate Members of the Committee</p><p>Jo Nolan, Secretary</p><p>Mr. No</p>"
    pages = [legacy, legacy.replace("<table>", "<table class='x'>"), "<p>Attendance<br>Ann Lee</p><p>rest", "<p>none</p>", None]
    made = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    found = {r.i: r.b for r in made.select("i", html.attendance_blocks(spark, F.col("html")).alias("b")).collect()}
    members = [["PRESENT:"], ["Mr. Lee, Chair", "Mr. Poe"], ["Ann Ray, Alternate Members of the Committee"]]
    assert found == {0: members, 1: members, 2: [["Attendance", "Ann Lee"], ["rest"]], 3: [], 4: []}


def test_attendance_with_a_registry(spark):
    some = [(1, [["Present", "Ms. Lee, Chair", "Ray", "Fox", "Bo Ray"]]), (2, [["Absent"]]), (3, [["PRESENT:", "Ann Lee", "Ann Lee"]])]
    rows = spark.createDataFrame(some, "document long, blocks array<array<string>>")
    registry = spark.createDataFrame([("Lee", "Ann Lee"), ("ray", "Bo Ray")], "surname string, full_name string")
    found = {(r.document, r.ordinal): (r.member, r.name, r.role, r.problem) for r in m.attendance(rows, registry).collect()}
    assert found == {
        (1, 1): ("ann-lee", "Ann Lee", "chair", None), (1, 2): ("bo-ray", "Bo Ray", "member", None), (1, 3): (None, "Fox", "member", "UNRESOLVED"), (1, 4): ("bo-ray", "Bo Ray", "member", "DUPLICATE"),
        (2, None): (None, None, None, "NO_LIST"), (3, 1): ("ann-lee", "Ann Lee", "member", None), (3, 2): ("ann-lee", "Ann Lee", "member", "DUPLICATE"), (3, None): (None, None, None, "CHAIRS"),
    }


def test_votes_meet_attendance_in_a_row(spark):
    blocks, paragraphs = [["Present", "Ann Lee, Chair", "Bo Ray", "Cy Poe"]], ["Voting for this action: Ann Lee and Bo Ray. Voting against this action: Di Fox.", "Voting for this action: Ann Lee. Voting against this action: Bo Ray."]
    rows = spark.createDataFrame([(1, blocks, paragraphs)], "document long, blocks array<array<string>>, paragraphs array<string>")
    found = {r.name: (r.member, r.role, r.is_chair, r.is_voter, r.against, r.problem) for r in m.roster_and_votes(rows).collect()}
    assert found == {
        "Ann Lee": ("ann-lee", "chair", True, True, False, None), "Bo Ray": ("bo-ray", "member", False, True, True, None), "Cy Poe": ("cy-poe", "member", False, False, None, None),
        "Di Fox": ("di-fox", None, False, True, True, "NOT_PRESENT"),
    }


def test_pages_are_read_once_and_stay_where_they_are(spark):
    for name in ("f23_vote_rounds", "f24_h07_attendance", "b17_roster_and_votes", "b21_roster_audit"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "size(CASE" not in plan and "size(concat(transform" not in plan, name  # the arrays' making is not repeated in a filter
        assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 1, name
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= (4 if name == "b21_roster_audit" else 1), (name, plan)


def test_lists_of_three_and_blanks_around_pieces(spark):
    blocks, paragraphs = [["Present", "Ann Lee, Chair"], ["Di Fox, Bo Ray, and Cy Poe, Alternate Members of the Committee"]], [" Voting for this action: Ann Lee.   Voting against this action: None. "]
    rows = spark.createDataFrame([(1, blocks, paragraphs)], "document long, blocks array<array<string>>, paragraphs array<string>")
    assert [(r.ordinal, r.name, r.problem) for r in m.attendance(rows).orderBy("ordinal").collect()] == [(1, "Ann Lee", None), (2, "Di Fox", None), (3, "Bo Ray", None), (4, "Cy Poe", None)]
    assert [(r.round, r.voted_for, r.voted_against, r.explicit) for r in m.vote_rounds(rows).collect()] == [(1, ["Ann Lee"], [], True)]
