"""Names of lists in texts, against patterns over every name."""

import random
import re

import pytest
from retrospect.operators import names


def _hidden(text, listed):
    terms = {n for n in listed} | {n.split()[-1] for n in listed if len(n.split()[-1]) >= 3}
    spans = sorted((-len(t), m.start(), m.end()) for t in terms for m in re.finditer(f"(?<![A-Za-z])(?=({re.escape(t)})(?![A-Za-z]))", text, re.I) for m in [_Span(m.start(), len(t))])
    kept = []
    for _, a, b in spans:
        if all(b <= c or a >= d for c, d in kept):
            kept.append((a, b))
    out = text
    for a, b in sorted(kept, reverse=True):
        out = out[:a] + "#" + out[b:]
    return out


class _Span:
    def __init__(self, a, n):
        self.start, self.end = (lambda: a), (lambda: a + n)


def test_drawn_texts_and_lists(spark):
    drawn = random.Random(5)
    parts = ["Ann", "ann", "Lee", "O'Neil", "B.", " ", " ", "-", "Ray", "x", "7", "Lee Ray", "\n", "é", "St. ", ".5"]
    lists = {i: [" ".join("".join(drawn.choices(parts, k=drawn.randint(1, 4))).split()) or "Z" for _ in range(drawn.randint(1, 12))] for i in range(8)}
    texts = [(i, i % 8, "".join(drawn.choices(parts, k=drawn.randint(0, 60)))) for i in range(120)]
    rows = spark.createDataFrame(texts, "text_id int, list_id int, text string")
    listed = spark.createDataFrame([(i, n) for i, some in lists.items() for n in some], "list_id int, name string")
    found = {r.text_id: r.text for r in names.redacted(rows, listed, "#").collect()}
    assert found == {i: _hidden(t, lists[at]) for i, at, t in texts}
    assert any("#" in t for t in found.values())


def test_literal_cases(spark):
    rows = [(1, 1, "Jane B. Doe, doe and Doer; Ann Lee"), (2, 2, "Jane B. Doe"), (3, None, "Doe"), (4, 1, None), (5, 1, ""), (6, 9, "Doe"), (7, 1, "Doe" * 40_000 + " Doe")]
    texts = spark.createDataFrame([(*r, "x") for r in rows], "text_id int, list_id int, text string, term string")
    listed = spark.createDataFrame([(1, " Jane B. Doe "), (1, "Jane B. Doe"), (1, None), (1, " "), (1, "\x1c"), (1, "\u00a0"), (2, "Bo Poe"), (None, "Doe")], "list_id int, name string")
    found = {r.text_id: r.text for r in names.redacted(texts, listed, "[M]").collect()}
    assert found == {1: "[M], [M] and Doer; Ann Lee", 2: "Jane B. Doe", 3: "Doe", 4: None, 5: "", 6: "Doe", 7: "Doe" * 40_000 + " [M]"}
    assert names.redacted(texts.limit(0), listed).count() == 0
    assert names.redacted(texts, listed.limit(0)).filter("text_id = 1").first().text == rows[0][2]


def test_a_list_of_many_names(spark):
    many = spark.range(50_000).selectExpr("0 as list_id", "concat('Ann ', char(65 + id % 26), '. Name', cast(id as string)) as term")
    text = "Ann C. Name2 and Ann D. Name2, Ann Z. Name49999 with Ann D. Name3"
    spans = names.name_spans(spark.createDataFrame([(1, 0, text)], "text_id int, list_id int, text string"), many)
    right = [n for n in ("Ann C. Name2", "Ann D. Name3") if n in text]
    last = f"Ann {chr(65 + 49_999 % 26)}. Name49999"
    assert sorted(r.term for r in spans.collect()) == sorted(right + [last] * (last in text))


@pytest.mark.parametrize("most", [1, 6])
def test_mentions(spark, most):
    members = [(1, "Ann Lee", 2, 5), (2, "Bo Lee", 1, 9), (3, "Cy O'Neil", 3, 2), (4, "Di Ray", 4, 1), (5, "Poe", 0, 2), (6, None, 9, 9)]
    texts = [(1, "Lee, O'Neil and Ray met Poe."), (2, "Leeds, lee and Lee_"), (3, None), (4, "(Lee) Lee")]
    found = names.member_mentions(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(members, "id int, name string, place int, votes int"), most=most)
    assert {r.text_id: r.ids for r in found.collect()} == {1: [5, 2, 3][:most], 4: [2]}


def test_short_and_long_lists_alike(spark, monkeypatch):
    drawn = random.Random(8)
    parts = ["Ann", "ann", "Lee", "O'Neil", "B.", " ", " ", "-", "\u212a", "k", "7", "Lee Ray", "\n", "\u0130", "St. ", ".5"]
    lists = [(i, " ".join("".join(drawn.choices(parts, k=drawn.randint(1, 4))).split()) or "Z") for i in range(6) for _ in range(1 + 3 * i)]
    texts = spark.createDataFrame([(i, i % 7, "".join(drawn.choices(parts, k=drawn.randint(0, 50)))) for i in range(90)], "text_id int, list_id int, text string")
    listed = spark.createDataFrame(lists, "list_id int, name string")
    hidden = lambda: {r.text_id: r.text for r in names.redacted(texts, listed, "#").collect()}
    all_short = hidden()
    assert "Generate" not in names.redacted(texts, listed, "#")._jdf.queryExecution().optimizedPlan().toString()  # no row for each token or size
    monkeypatch.setattr(names, "_SHORT", 6)
    some_long = hidden()
    monkeypatch.setattr(names, "_SHORT", 0)
    assert all_short == some_long == hidden() and any("#" in t for t in all_short.values())


def test_places_without_a_first_token_are_left_out():
    text = "It was said that Ann Lee met Bo."
    assert [p[0] for p in names.token_keys(text, [1, 3], heads=frozenset(["ann", "bo"]))] == [17, 29]
    assert len(list(names.token_keys(text, [1, 3]))) == 8


def test_texts_of_a_row_are_hidden_as_those_of_a_list(spark):
    from pyspark.sql import functions as F

    lists = [["Ann Lee", " Bo Ray\t", None, "", "Li"], ["É. Blé", "O'Brien", "Mary-Jane Watson Jr."], [f"Al N{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)], []]
    texts = [["LEE met Ann  Lee, Ann Lee-Ray and Leeds", None, "", "Lixx Li bo ray"], ["É. BLÉ and blé; O'BRIEN'S; Watson Jr.", "Obrien"], ["Nak Nbl nakx Al Ncm, al ncm", "x"], ["Ann Lee"]]
    rows = spark.createDataFrame(list(zip(range(4), texts, lists)), "i int, texts array<string>, names array<string>")
    each = rows.select(F.col("i").alias("list_id"), F.posexplode("texts").alias("at", "text")).withColumn("text_id", F.concat_ws("-", "list_id", "at"))
    want = {r.text_id: r.text for r in names.redacted(each, rows.select(F.col("i").alias("list_id"), F.explode("names").alias("name"))).collect()}
    found = rows.select("i", names.redacted_in_row(spark, F.col("texts"), F.col("names")).alias("t")).collect()
    assert {f"{r.i}-{k}": t for r in found for k, t in enumerate(r.t)} == want and want["0-0"].startswith("[REDACTED_PARTICIPANT] met Ann  [RED")


def test_plain_spans_are_those_of_tokens():
    import random

    draw = random.Random(3)
    for _ in range(2000):
        text = "".join(draw.choice("aAbB -'.1") for _ in range(draw.randrange(14)))
        terms = {"".join(draw.choice("abB -'.1") for _ in range(draw.randrange(1, 5))).strip() for _ in range(4)} - {""}
        assert names.spans_of(text, terms) == names.spans_of(text + "é", terms), (text, terms)  # the letter beyond ASCII has all tokens cut


def test_mentions_without_rows_of_tokens(spark, monkeypatch):
    texts = [(1, "Lee met O'Brien, Poe and poe."), (2, "Leeds O'Briens"), (3, None), (4, ""), (5, "Smith-Jones_ Smith-Jones x"), (6, "Lee " * 3 + "Ray Poe")]
    members = [(9, "Ann Lee", 1, 2), (8, "Bo Lee", 0, 2), (7, "Cy O'Brien", 2, 5), (6, "Di Poe", 3, 2), (5, "Ed Smith-Jones", 4, 2), (4, "Flo Ray", 5, 1)]
    made = lambda: names.member_mentions(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(members, "id int, name string, place int, votes int"), most=2)
    plan = made()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    short = {r.text_id: r.ids for r in made().collect()}
    monkeypatch.setattr(names, "_HEADS", 0)
    assert short == {r.text_id: r.ids for r in made().collect()} == {1: [8, 7], 5: [5], 6: [8, 6]}
