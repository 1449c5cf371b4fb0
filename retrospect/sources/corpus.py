"""Texts of meetings derived from the driver's tables: statements, minutes, pages and articles, with what they say in SQL.

An order is a meeting, its suppliers are the members, returned lines are dissents; the member with the smallest id chairs
and never dissents. The texts spell these records out, so that parsers can be held against the records themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as s

#: Parts of the members' names.
GIVEN = ("Anna", "Boris", "Clara", "David", "Ellen")
LETTERS = "bcdfghklmp"
#: What a statement says of the economy, by the order's priority, with the condition labels of each.
CONDITIONS = {
    "1-URGENT": ("Inflation remains elevated and job gains have been strong in recent months.", ["infl_high", "labor_tight"]),
    "2-HIGH": (
        "Economic activity has slowed and strains in financial markets have increased further in recent weeks.",
        ["fin_stress", "growth_weak", "stress_intensifying"],
    ),
    "3-MEDIUM": ("The economy is expanding at a moderate pace and the labor market has weakened a little.", ["labor_soft", "growth_solid"]),
    "4-NOT SPECIFIED": ("Inflation has picked up and financial conditions have improved over the winter months.", ["infl_high", "infl_accelerating", "stress_easing"]),
    "5-LOW": ("Job losses have mounted and inflation has been running below the level that was hoped for.", ["infl_low", "labor_soft", "labor_deteriorating"]),
}
OUTLOOK = (
    "The staff sees the outlook for spending as uncertain, credit as less plentiful than it was a year ago, and price stability as a matter "
    "of continued attention for members across all of the districts that sent in reports on the economy."
)
GUIDANCE = "The Committee anticipates that it will be appropriate to raise the target range for the federal funds rate."
_ACTION = {"CUT": ("lower", "to"), "HIKE": ("raise", "to"), "HOLD": ("maintain", "at")}
_ALL = "ORDER BY participant"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows in as many partitions as the session shuffles to: reading a text costs more than its bytes would tell.

    Records are dealt before their texts are made; what is grouped or joined by the key then stays where it is.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def member_name(member: Column) -> Column:
    given = F.element_at(F.array(*[F.lit(g) for g in GIVEN]), (F.pmod(member, F.lit(5)) + 1).cast("int"))
    middle = F.when(F.pmod(member, F.lit(3)) == 0, " B. ").otherwise(" ")
    return F.concat(given, middle, F.initcap(F.translate(F.lpad(member.cast("string"), 5, "0"), "0123456789", LETTERS)))


def name_sql(member: str) -> str:
    last = f"translate(lpad({member}::VARCHAR, 5, '0'), '0123456789', '{LETTERS}')"
    given = "[" + ", ".join(f"'{g}'" for g in GIVEN) + "]"
    return f"({given}[({member} % 5 + 1)::INTEGER] || CASE WHEN {member} % 3 = 0 THEN ' B. ' ELSE ' ' END || upper({last}[1]) || {last}[2:])"


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, ids, names, voted_for, voted_against: members in order of id; the first chairs. Dealt by meeting."""
    cast = dealt(s.votes(spark, sf_dir).select("meeting", "participant", "dissent"), "meeting")
    votes = cast.groupBy("meeting", "participant").agg(F.max("dissent").alias("dissent")).groupBy("meeting").agg(F.sort_array(F.collect_list(F.struct("participant", "dissent"))).alias("m"))
    named = F.transform("m", lambda x, i: F.struct(x["participant"].alias("id"), member_name(x["participant"]).alias("name"), (x["dissent"] & (i > 0)).alias("no")))
    people = votes.select("meeting", named.alias("m"))
    pick = lambda no: F.transform(F.filter("m", lambda x: x["no"] == no), lambda x: x["name"])
    return people.select("meeting", F.col("m.id").alias("ids"), F.col("m.name").alias("names"), pick(False).alias("voted_for"), pick(True).alias("voted_against"))


#: meeting, participant, name, chair, no: one row a member; and the lists of names by side.
ROSTER_SQL = f"""{s.VOTES_SQL}, ros AS (SELECT meeting, participant, {name_sql('participant')} AS name, participant = min(participant) OVER (PARTITION BY meeting) AS chair,
dissent AND participant <> min(participant) OVER (PARTITION BY meeting) AS no FROM mv),
sides AS (SELECT meeting, list(name {_ALL}) AS names, coalesce(list(name {_ALL}) FILTER (NOT no), []) AS voted_for, coalesce(list(name {_ALL}) FILTER (no), []) AS voted_against FROM ros GROUP BY 1)"""


def spoken_list(names: Column, mark: str = "; ") -> Column:
    """A; B; and C."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), mark)
    return F.when(n > 1, F.concat(head, F.lit(f"{mark}and "), F.element_at(names, -1))).otherwise(head)


def _with_chair(names: Column) -> Column:
    return F.transform(names, lambda x, i: F.when(i == 0, F.concat(x, F.lit(", Chair"))).otherwise(x))


def rate_token(quarters: Column) -> Column:
    """Quarters of a percent as 3-1/2, 1/4 or 5."""
    whole, rest = F.floor(quarters / 4).cast("string"), F.pmod(quarters, F.lit(4))
    part = F.when(rest == 1, "1/4").when(rest == 2, "1/2").when(rest == 3, "3/4")
    return F.when(rest == 0, whole).when(quarters < 4, part).otherwise(F.concat_ws("-", whole, part))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, date, priority, action, statement and the roster's columns for every order. Dealt by meeting; no text is shuffled."""
    meetings = dealt(s.outcomes(spark, sf_dir, F.col("o_orderpriority").alias("priority")), "meeting")
    rows = meetings.join(rosters(spark, sf_dir).hint("merge"), "meeting", "left")
    conditions = F.lit(None).cast("string")
    for priority, (words, _) in CONDITIONS.items():
        conditions = F.when(F.col("priority") == priority, words).otherwise(conditions)
    verb, to = F.lit(None).cast("string"), F.lit("to")
    for action, (v, t) in _ACTION.items():
        verb, to = F.when(F.col("action") == action, v).otherwise(verb), F.when(F.col("action") == action, t).otherwise(to)
    quarters = F.pmod("meeting", F.lit(20))
    decision = F.concat(
        F.when(F.pmod("meeting", F.lit(3)) == 0, GUIDANCE + " ").otherwise(""), F.lit("The Committee decided to "), verb,
        F.lit(" the target range for the federal funds rate "), to, F.lit(" "), rate_token(quarters), F.lit(" to "), rate_token(quarters + 1), F.lit(" percent."),
    )
    no = F.size("voted_against")
    preferred = F.when(F.pmod("meeting", F.lit(2)) == 0, "raise").otherwise("lower")
    against = F.concat(
        F.lit("Voting against this action "), F.when(no > 1, "were ").otherwise("was "), spoken_list(F.col("voted_against")),
        F.lit(", who preferred to "), preferred, F.lit(" the target range at this meeting."),
    )
    vote = F.concat(
        F.lit("\n\nThe decision was taken by a "), F.size("voted_for").cast("string"), F.lit("-"), no.cast("string"),
        F.lit(" vote. Voting for the monetary policy action were "), spoken_list(_with_chair(F.col("voted_for"))), F.lit("."),
        F.when(no > 0, F.concat(F.lit(" "), against)).otherwise(""),
    )
    said = F.concat(conditions, F.lit(f"\n\n{OUTLOOK}\n\n"), decision, F.coalesce(vote, F.lit(""))).alias("statement")
    return rows.select("meeting", F.col("decided_on").alias("date"), "priority", "action", "ids", "names", "voted_for", "voted_against", said)


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, minute: a heading and one paragraph for each line of an order with an even key. Dealt by meeting; no text is shuffled."""

    def body(x: Column) -> Column:
        opening = F.when(x["l_returnflag"] == "A", "Several participants noted that inflation").when(x["l_returnflag"] == "N", "It was said that inflation")
        return F.concat(
            opening.otherwise("It was said that the weather"), F.lit(" had been a topic in "), x["l_suppkey"].cast("string"),
            F.lit(" of the reports, " + "that views differed on how long this would last, and that more would be known by the next meeting, " * 2 + "as item "),
            x["l_partkey"].cast("string"), F.lit("-"), x["l_linenumber"].cast("string"), F.lit(" shows."),
        )

    fields = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = s.table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("meeting"), F.struct(*fields).alias("l"))
    said = F.transform("ls", lambda x: F.struct(x["l_linenumber"].alias("n"), x["l_partkey"].alias("p"), body(x).alias("t")))
    text = F.array_join(F.transform(F.sort_array(said), lambda x: x["t"]), "\n")
    grouped = dealt(lines, "meeting").groupBy("meeting").agg(F.collect_list("l").alias("ls"))
    return grouped.select("meeting", F.concat(F.lit("Participants' Views on Current Conditions\n"), text).alias("minute"))


def minutes_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, html: attendance (a modern block, or lines of a table in every fourth) and the vote. Dealt by meeting; no text is shuffled."""
    role = F.transform(
        "names", lambda x, i: F.when(i == 0, F.concat(x, F.lit(", Chair"))).when((i == 1) & (F.size("names") > 4), F.concat(x, F.lit(", Vice Chair"))).otherwise(x)
    )
    modern = F.concat(F.lit("<p><strong>PRESENT:</strong><br>"), F.array_join(role, "<br/>"), F.lit("</p>"))
    legacy = F.concat(F.lit("<table><tr><td>PRESENT:</td></tr><tr><td>"), F.array_join(F.transform(role, lambda x: F.concat(F.lit("Mr. "), x)), "<br>"), F.lit("</td></tr></table>"))
    staff = F.lit("<p>Jo Nolan, Secretary</p><p>Al Borg, Economist</p>")
    alternates = F.lit("<p>Xavier Quill and Yves Rand, Alternate Members of the Committee</p>")
    no = F.size("voted_against")
    vote = F.concat(F.lit("<p>Voting for this action: "), spoken_list(F.col("voted_for"), ", "), F.lit(".</p>"))
    against = F.when(no > 0, F.concat(F.lit("<p>Voting against this action: "), spoken_list(F.col("voted_against"), ", "), F.lit(".</p>")))
    none = F.when(F.pmod("meeting", F.lit(2)) == 0, "<p>Voting against this action: None.</p>").otherwise("")
    board = F.when(F.pmod("meeting", F.lit(7)) == 0, "<p>Votes for these actions: the Board.</p>").otherwise("")
    old = F.pmod("meeting", F.lit(4)) == 3
    return rosters(spark, sf_dir).select(
        "meeting", "names",
        F.concat(F.lit("<html><body>"), F.when(old, legacy).otherwise(F.concat(modern, alternates)), staff, F.lit("<p>The meeting began.</p>"), vote, F.coalesce(against, none), board, F.lit("</body></html>")).alias("html"),
    )


#: How each kind of site lays out an article.
SITES = ("board", "dallas", "chicago", "boston", "san_francisco", "richmond")


def article_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, site, url, html: an article for every order, in the layout of one of six sites, by one of its customer's three speakers."""
    o = s.table(spark, sf_dir, "orders")
    day, number = F.to_date("o_orderdate"), F.col("o_orderkey").cast("string")
    speaker = member_name(F.pmod("o_custkey", F.lit(300)))
    title = F.concat(F.lit("Remarks on inflation &amp; item "), number)
    first = F.concat(F.lit("<p>Inflation was "), F.col("o_orderstatus"), F.lit("<br>in item "), number, F.lit(".</p>"))
    second = F.lit("<p>Employment&nbsp;held.</p>")
    long_day = F.date_format(day, "MMMM dd, yyyy")
    site = F.element_at(F.array(*[F.lit(x) for x in SITES]), (F.pmod("o_orderkey", F.lit(len(SITES))) + 1).cast("int"))
    page = {
        "board": F.concat(F.lit("<p>Menu</p><div id='article'><p class='article__time'>"), long_day, F.lit("</p><h3 class='title'>"), title, F.lit("</h3><p class='speaker'>"), speaker, F.lit("</p><p class='location'>Here</p>"), first, F.lit("<div class='footnotes'><p>1. Note.</p></div>"), second, F.lit("<hr><p>After the rule</p></div><p>Foot</p>")),
        "dallas": F.concat(F.lit("<div class='dal-main-content'><div class='dal-crouton'>Speech by "), speaker, F.lit("</div><h1 class='dal-headline'>"), title, F.lit("</h1>"), F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.concat(F.lit("<p class='dal-content-date'>"), long_day, F.lit("</p>"))).otherwise(""), first, F.lit("<div class='share-box'><p>Share</p></div>"), second, F.lit("</div>")),
        "chicago": F.concat(F.lit("<div class='cfedDetail__title'><h1>"), title, F.lit("</h1></div><div class='cfedDetail__lastUpdated'>Last Updated: "), F.date_format(day, "MM/dd/yy"), F.lit("</div><div class='cfedContent__text'>"), first, second, F.lit("</div>")),
        "boston": F.concat(F.lit("<meta property='article:published_time' content='"), F.date_format(day, "yyyy-MM-dd'T'10:00:00'Z'"), F.lit("'><meta itemprop='name' content='"), title, F.lit("'><a class='byline-link' href='/p'>"), speaker, F.lit("</a><a href='/-/media/Documents/speeches/pdf/collins/"), number, F.lit(".pdf?x=1'>Full-text (PDF)</a><p>Teaser</p>")),
        "san_francisco": F.concat(F.lit("<meta property='article:published_time' content='"), F.date_format(day, "yyyy-MM-dd'T'10:00:00XXX"), F.lit("'><meta name='parsely-author' content='"), speaker, F.lit("'><main class='sffed-main-content'><h1 class='wp-block-post-title'>"), title, F.lit("</h1><div class='entry-content wp-block-post-content'>"), first, F.lit("<ul><li><p>Employment&nbsp;held.</p></li></ul><h3 class='sffed-associated-people__heading--in-content-flow'>People</h3><p>Bio</p></div></main>")),
        "richmond": F.concat(F.lit("<meta name='citation_title' content='"), title, F.lit("'><meta name='citation_author' content='"), speaker, F.lit("'><meta name='citation_publication_date' content='"), F.date_format(day, "yyyy/MM/dd"), F.lit("'><p>Menu</p><div class='tmplt__content'>"), first, second, F.lit("</div>")),
    }
    html = F.lit(None).cast("string")
    for name, text in page.items():
        html = F.when(site == name, text).otherwise(html)
    url = F.concat(F.lit("https://www.example.org/"), site, F.lit("/lkl"), F.date_format(day, "yyMMdd"))
    o = dealt(o, "o_orderkey")
    return o.select(F.col("o_orderkey").alias("page_id"), site.alias("site"), url.alias("url"), F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")).alias("html"))
