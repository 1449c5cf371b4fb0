"""Votes and attendance of minutes: clauses to rounds, line blocks to roles, and what can't be read kept as problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug

#: How vote clauses begin, names, honorifics, and capitalised words that are no names.
CLAUSE = r"(?i)\b(?:Voting|Votes)\s+(?:for|against)\b"
FOR_LINE = r"(?i)^(?:Voting|Votes) for\s+(?:(?:this|the) action|(?:the )?(?:FOMC )?monetary policy action)(?:\s+were)?\s*:?\s*(.+?)\s*$"
AGAINST_LINE = r"(?i)^(?:Voting|Votes) against\s+(?:(?:(?:this|the) action|the policy(?: action)?|(?:the )?(?:FOMC )?monetary policy action)(?:\s+(?:was|were))?|(?:was|were))\s*:?\s*(.+?)\s*$"
BOARD_LINE = r"(?i)^Votes\s+(?:for|against)(?:\s+these actions)?\s*:"
FULL_NAME = r"\b[A-Z][A-Za-z'’\-]+(?:\s+(?:[A-Z]\.|[A-Z][A-Za-z'’\-]+))*\s+[A-Z][A-Za-z'’\-]+(?:\s+(?:Jr|Sr)\.?)?"
NOT_NAMES = ("vice chair", "vice chairman", "federal reserve", "board of governors", "open market", "market committee")
HONORIFIC = r"(?i)^(?:Messrs|Mses|Mr|Ms|Mrs|Dr)\.\s+"
REMARK = r"(?i)\.\s+(?=(?:Mr|Ms|Mrs|Governor|President|Statement|The|Consistent)\b)"
REASON = r",\s+(?i:who|which)\b"
REASON_UP_TO_NAME = r",\s+(?i:who|which)\b.*?(?=(?:;\s+(?:and\s+)?|,\s+and\s+|\s+and\s+)[A-Z][A-Za-z'-]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][A-Za-z'-]+)+)"
#: Words that end the list of participants, and the groups in it.
STAFF = r"(?i), secretary|, general counsel|, economist"
ALTERNATES, PRESIDENTS = r"(?i)alternate members of", r"(?i)presidents of the federal reserve banks"


def clean_paragraph(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("**"), F.lit("")), "[\\s ]+", " "))


def vote_names(listed: Column) -> Column:
    """Names of a vote list: whole names, or what follows honorifics; none for "None"."""
    cleaned = F.trim(F.regexp_replace(F.trim(listed), r"[.]+$", ""))
    region = F.get(F.split(F.regexp_replace(F.get(F.split(cleaned, REMARK), F.lit(0)), REASON_UP_TO_NAME, ""), REASON), F.lit(0))
    whole = F.filter(F.regexp_extract_all(region, F.lit(FULL_NAME), F.lit(0)), lambda n: ~F.lower(n).isin(*NOT_NAMES))
    bare = F.get(F.split(F.get(F.split(F.regexp_replace(cleaned, r"(?i),\s+(?:who|which)\b.*?;\s+and\s+", ", "), REASON), F.lit(0)), REMARK), F.lit(0))
    commas = F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit(";"), F.lit(",")), r"(?i),\s+and\s+", ", "), r"(?i)\s+and\s+", ", ")
    titled = F.filter(F.transform(F.split(commas, ","), lambda n: F.regexp_replace(F.trim(n), HONORIFIC, "")), lambda n: n != "")
    return F.when(cleaned.rlike(r"(?i)^none\b"), F.array().cast("array<string>")).when(cleaned.rlike(HONORIFIC), titled).otherwise(whole)


def _each(rows: DataFrame, name: str) -> DataFrame:
    """document and the fields of each struct of an array. An inner explode would have its filter computed from the pages again, below the arrays' making."""
    return rows.select("document", F.explode_outer(name).alias("r")).filter("r is not null").select("document", "r.*")


def vote_clauses(documents: DataFrame) -> DataFrame:
    """document, clauses: the vote clauses (kind FOR, AGAINST or UNREADABLE, names) of documents (document, paragraphs, ...) in order; other columns stay.

    Votes of the board that name no policy action are left out.
    """
    pieces = lambda p: F.transform(F.split(clean_paragraph(p), f"(?={CLAUSE})"), lambda t: F.trim(t))
    clauses = F.filter(F.flatten(F.transform("paragraphs", pieces)), lambda c: c.rlike(f"^{CLAUSE}"))
    read = F.transform("clauses", lambda c: F.struct(c.alias("clause"), F.regexp_extract(c, FOR_LINE, 1).alias("side_for"), F.regexp_extract(c, AGAINST_LINE, 1).alias("side_against")))
    kind = lambda c: F.when(c["side_for"] != "", "FOR").when(c["side_against"] != "", "AGAINST").when(~c["clause"].rlike(BOARD_LINE), "UNREADABLE")
    listed = lambda c: F.when(c["side_for"] != "", c["side_for"]).when(c["side_against"] != "", c["side_against"])
    named = F.transform("clauses", lambda c: F.struct(kind(c).alias("kind"), vote_names(listed(c)).alias("names")))
    return documents.withColumn("clauses", clauses).withColumn("clauses", read).withColumn("clauses", named).withColumn("clauses", F.filter("clauses", lambda c: c["kind"].isNotNull()))


def voted(documents: DataFrame) -> DataFrame:
    """document, rounds: what vote_rounds has of a document, as an array. A document is one row and stays one; nothing is shuffled."""
    empty = F.array().cast("array<string>")
    beside = lambda c, i: F.struct(
        c["kind"].alias("kind"), c["names"].alias("names"), F.when(i > 0, F.get("clauses", i - 1)["kind"]).alias("before"), F.get("clauses", i + 1)["kind"].alias("after"),
        F.when(F.get("clauses", i + 1)["kind"] == "AGAINST", F.get("clauses", i + 1)["names"]).otherwise(empty).alias("against"),
    )
    repeated = lambda names: F.size(F.array_distinct(names)) < F.size(names)
    problem = lambda c: (
        F.when(c["kind"] == "UNREADABLE", "UNREADABLE")
        .when(c["kind"] == "AGAINST", F.when(~F.equal_null(c["before"], F.lit("FOR")), "AGAINST_FIRST"))
        .when(F.size(c["names"]) == 0, "EMPTY_FOR")
        .when(repeated(c["names"]) | repeated(c["against"]), "DUPLICATE")
        .when(F.arrays_overlap(c["names"], c["against"]), "BOTH_SIDES")
    )
    judged = F.transform("clauses", lambda c: F.struct(c.alias("c"), problem(c).alias("problem")))
    row = lambda number, names, against, explicit, why: F.struct(number.alias("round"), names.alias("voted_for"), against.alias("voted_against"), explicit.alias("explicit"), why.alias("problem"))
    nothing = (F.lit(None).cast("long"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("boolean"))
    good = F.filter("clauses", lambda x: x["problem"].isNull() & (x["c"]["kind"] == "FOR"))
    rounds = F.transform(good, lambda x, i: row((i + 1).cast("long"), x["c"]["names"], x["c"]["against"], F.equal_null(x["c"]["after"], F.lit("AGAINST")), F.lit(None).cast("string")))
    bad = F.transform(F.filter("clauses", lambda x: x["problem"].isNotNull()), lambda x: row(*nothing, x["problem"]))
    clauses = vote_clauses(documents).withColumn("clauses", F.transform("clauses", beside)).withColumn("clauses", judged)
    found = clauses.withColumn("rounds", F.concat(rounds, bad)).drop("clauses")
    return found.withColumn("rounds", F.when(F.size("rounds") > 0, F.col("rounds")).otherwise(F.array(row(*nothing, F.lit("NO_VOTE")))))


def vote_rounds(documents: DataFrame) -> DataFrame:
    """One row a round: document, round, voted_for, voted_against, explicit (whether a clause says who was against), problem.

    documents: document (once), paragraphs. An against clause belongs to the for clause right before it. Rows with a problem
    are no rounds: round is null. A document without any clause gives one row with the problem NO_VOTE.
    """
    return _each(voted(documents.select("document", "paragraphs")), "rounds")


def vote_audit(rounds: DataFrame) -> DataFrame:
    """One row of counts over vote_rounds: documents, those read, rounds, votes, rounds with dissent, implicit ones, problems."""
    good = F.col("problem").isNull()
    return rounds.agg(
        F.count_distinct("document").alias("documents"), F.count_distinct(F.when(good, F.col("document"))).alias("read"), F.count_if(good).alias("rounds"),
        F.sum(F.when(good, F.size("voted_for") + F.size("voted_against")).otherwise(0)).alias("votes"),
        F.count_if(good & (F.size("voted_against") > 0)).alias("with_dissent"), F.count_if(good & ~F.col("explicit")).alias("implicit"), F.count_if(~good).alias("problems"),
    )


def _group_names(line: Column, group: str) -> Column:
    head = F.regexp_extract(line, rf"(?i)^(.*?),\s*\d*\s*{group}", 1)
    bare = F.regexp_replace(F.regexp_replace(head, r"(?i)\b(?:Messrs|Mses|Mr|Ms|Mrs|Dr)\.\s*", ""), r",?\s*\d+\b", "")
    return F.filter(F.transform(F.split(F.regexp_replace(bare, r"(?i),?\s+and\s+", ","), ","), lambda n: F.trim(n)), lambda n: n != "")


def attended(documents: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """document, people: what attendance has of a document, as an array; other columns stay. Without a registry a document stays its row and nothing is shuffled."""
    strings = F.array().cast("array<string>")
    heads = F.transform("blocks", lambda b: F.lower(F.regexp_replace(F.trim(F.get(b, F.lit(0))), ":$", "")).isin("present", "attendance"))
    begun = documents.withColumn("first", F.coalesce(F.array_position(heads, True), F.lit(0)))
    own = F.get("blocks", F.col("first").cast("int") - 1)
    alone = F.size(own) == 1
    lines = F.when(alone, F.get("blocks", F.col("first").cast("int"))).otherwise(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))))
    after = F.slice("blocks", (F.col("first") + F.when(alone, 2).otherwise(1)).cast("int"), F.size("blocks"))
    shown = begun.withColumns({"lines": F.when(F.col("first") > 0, lines), "rest": F.when(F.col("first") > 0, F.transform(after, lambda b: F.array_join(b, " ")))})
    staff = F.array_position(F.transform("rest", lambda t: t.rlike(STAFF)), True)
    groups = F.filter(F.when(staff > 0, F.slice("rest", F.lit(1), (staff - 1).cast("int"))).otherwise(F.col("rest")), lambda t: t.rlike(ALTERNATES) | t.rlike(PRESIDENTS))
    entries = F.concat(F.coalesce("lines", strings), F.coalesce(groups, strings))
    kinds = F.transform(entries, lambda t: F.struct(
        t.alias("line"), F.when(t.rlike(ALTERNATES), "alternate_member").when(t.rlike(PRESIDENTS), "reserve_bank_president").alias("group"), F.lower(F.trim(F.regexp_extract(t, "^[^,]*,(.*)$", 1))).alias("title")
    ))
    role = lambda x: F.coalesce(x["group"], F.when(x["title"].isin("chair", "chairman"), "chair").when(x["title"] == "vice chair", "vice_chair").otherwise("member"))
    names = lambda x: (
        F.when(x["group"] == "alternate_member", _group_names(x["line"], "Alternate Members of"))
        .when(x["group"] == "reserve_bank_president", _group_names(x["line"], "Presidents of the Federal Reserve Banks"))
        .otherwise(F.array(F.regexp_replace(F.trim(F.regexp_extract(x["line"], "^([^,]*)", 1)), HONORIFIC, "")))
    )
    key = lambda said: F.when(~F.contains(said, F.lit(" ")), F.lower(F.regexp_replace(said, r"[.]$", "")))
    entry = lambda x: F.transform(names(x), lambda said: F.struct(role(x).alias("role"), said.alias("said"), key(said).alias("surname")))
    said = shown.withColumn("people", kinds).withColumn("people", F.flatten(F.transform("people", entry)))
    known = lambda x: F.when(x["surname"].isNull(), x["said"])
    if registry is not None:
        each = said.select("document", F.posexplode("people").alias("at", "p")).withColumn("surname", F.col("p.surname"))
        found = each.join(registry.select(F.lower("surname").alias("surname"), "full_name"), "surname", "left")
        one = F.struct("at", F.col("p.role").alias("role"), F.col("p.said").alias("said"), "surname", "full_name")
        said = said.drop("people").join(found.groupBy("document").agg(F.sort_array(F.collect_list(one)).alias("people")), "document", "left")
        known = lambda x: F.when(x["surname"].isNull(), x["said"]).otherwise(x["full_name"])
    listed = said.withColumn("people", F.transform(F.coalesce("people", F.array()), lambda x: F.struct(x["role"].alias("role"), x["said"].alias("said"), known(x).alias("name"))))
    listed = listed.withColumn("members", F.transform("people", lambda x: slug(x["name"])))
    unresolved = lambda n: n.isNull() | ~n.rlike(f"^(?:{FULL_NAME})$")
    person = F.transform("people", lambda x, i: F.struct(
        (i + 1).alias("ordinal"), F.get("members", i).alias("member"), F.coalesce(x["name"], x["said"]).alias("name"), x["role"].alias("role"),
        F.when(unresolved(x["name"]), "UNRESOLVED").when(F.array_position("members", F.get("members", i)) <= i, "DUPLICATE").alias("problem"),
    ))
    text = F.lit(None).cast("string")
    whole = lambda why: F.array(F.struct(F.lit(None).cast("int").alias("ordinal"), text.alias("member"), text.alias("name"), text.alias("role"), F.lit(why).alias("problem")))
    chairs = F.size(F.filter("people", lambda x: x["role"] == "chair"))
    about = F.when(F.col("first") == 0, whole("NO_LIST")).when((F.size("people") > 0) & (chairs != 1), whole("CHAIRS")).otherwise(F.slice(whole(""), 1, 0))
    return listed.withColumn("people", F.concat(person, about)).drop("blocks", "first", "lines", "rest", "members")


def attendance(documents: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """document, ordinal, member, name, role, problem: the policy participants of documents (document, once, and blocks of lines).

    The list begins at a block headed PRESENT or ATTENDANCE (its lines follow in it or in the next block); later blocks
    add alternates and presidents up to the first of the staff. A document is read once, in its row. A single word is a
    surname, looked up in the registry
    (surname, full_name). Problems of a document (NO_LIST, CHAIRS) come in a row without a name; those of a name
    (UNRESOLVED, DUPLICATE) in its row.
    """
    return _each(attended(documents.select("document", "blocks"), registry), "people")


def roster_audit(rows: DataFrame) -> DataFrame:
    """One row of counts over attendance: documents, those without a problem, members, distinct members, chairs, problems.

    Rows are grouped by document first, where attendance has left them, so rows and their problems are read once.
    """
    chair = F.when(F.col("role") == "chair", F.col("name"))
    each = rows.groupBy("document").agg(F.count("problem").alias("problems"), F.count("*").alias("n"), F.collect_list(F.struct("member", chair.alias("chair"))).alias("people"))
    good = (F.col("problems") == 0) | F.col("document").isNull()
    first = F.col("at") == 0
    people = each.select("document", "problems", good.alias("good"), "n", F.posexplode("people").alias("at", "p"))
    counted = lambda c: F.when(F.col("good"), c)
    return people.agg(
        F.count(F.when(first, F.col("document"))).alias("documents"), F.sum(F.when(first, F.col("problems")).otherwise(0)).alias("problems"),
        F.count(F.when(first & F.col("good"), F.col("document"))).alias("read"), F.coalesce(F.sum(F.when(first, counted(F.col("n")))), F.lit(0)).alias("members"),
        F.count_distinct(counted(F.col("p.member"))).alias("distinct_members"), F.count_distinct(counted(F.col("p.chair"))).alias("chairs"),
    )


def roster_and_votes(documents: DataFrame) -> DataFrame:
    """document, member, name, role, is_chair, is_voter, against, problem: attendance with the votes of documents (document, once, blocks, paragraphs).

    A voter who is not on the list comes with the problem NOT_PRESENT. Several rounds count as one, against if in any.
    Both are read in the document's row; nothing is joined.
    """
    side = lambda name: F.array_distinct(F.flatten(F.transform(F.filter("rounds", lambda r: r["problem"].isNull()), lambda r: r[name])))
    both = attended(voted(documents)).select("document", F.filter("people", lambda p: p["problem"].isNull()).alias("people"), side("voted_for").alias("ayes"), side("voted_against").alias("noes"))
    against = lambda name: F.when(F.array_contains("noes", name), True).when(F.array_contains("ayes", name), False)
    row = lambda member, name, role, problem: F.struct(
        member.alias("member"), name.alias("name"), role.alias("role"), F.equal_null(role, F.lit("chair")).alias("is_chair"), against(name).isNotNull().alias("is_voter"), against(name).alias("against"), problem.alias("problem")
    )
    none = F.lit(None).cast("string")
    present = F.transform("people", lambda p: row(p["member"], p["name"], p["role"], none))
    strange = F.transform(F.array_except(F.array_union("ayes", "noes"), F.transform("people", lambda p: p["name"])), lambda n: row(slug(n), n, none, F.lit("NOT_PRESENT")))
    return _each(both.select("document", F.concat(present, strange).alias("all")), "all")
