"""Hard negatives and lexical search against brute force: ties, repeats, nulls, huge components, clashing names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from retrospect.llm.ball_tree import BallTree, Best, Rows, lexical_search
from retrospect.llm.negatives import BlockScorer, PackedBlock, mine_hard_negatives, quantised
from retrospect.llm.queries import ORACLES, QUERIES
from retrospect.llm.query_groups import query_groups

VECTORS = "vec_id long, embedding array<double>, label int, number string, score string, vec string, n_rows string, place string, rank string"


def _negatives(rows, scale=256, n_positive=5, n_negative=10, low=30, high=90):
    whole = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        whole.append((vec_id, label, tuple(math.floor(x * scale) for x in vector)))
    out = []
    for a in {r for r in whole if r[0] % 100 == 0}:
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2], strict=False))  # noqa: E731, B023
        first = lambda found: sorted((-score(r), r[0]) for r in found)  # noqa: E731, B023
        for place, (negated, positive) in enumerate(first(r for r in whole if r[1] == a[1] and r[0] != a[0])[:n_positive]):
            fits = [r for r in whole if r[1] != a[1] and -low * negated <= 100 * score(r) <= -high * negated]
            for rank, (n, negative) in enumerate(first(fits)[:n_negative]):
                out.append((a[0], positive, place + 1, rank + 1, negative, -negated, -n))
    return sorted(out)


def _mined(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, mine_hard_negatives(quantised(frame, label, 256), F.col("vec_id") % 100 == 0, **settings).collect()))


def _vector_rows(largest):
    rng = random.Random(11)
    rows = []
    for i in range(700):
        vector = [rng.choice((-1, -0.25, 0, 0.004, 0.5, 1)) * largest for _ in range(rng.choice((3, 6, 6)))]
        rows.append((i if i % 90 else 100 * (i // 90), vector, rng.randrange(3)))  # some ids repeat
    rows += [rows[1], rows[200], rows[200], (800, rows[200][1], 1), (801, None, 1), (802, [1.0, None], 1), (803, [float("nan")], 1)]
    rows += [(804, [float("inf")] * 6, 1), (805, [1.0] * 6, None), (None, [1.0] * 6, 1), (900, [], 2), (1000, [0.0] * 6, 0)]
    return rows


@pytest.mark.parametrize("largest", [1.0, 300.0, 5e5])
def test_hard_negatives_against_brute_force(spark, largest):
    rows = _vector_rows(largest)
    found = _mined(spark, rows, block_rows=64)
    assert found == _negatives(rows) and found
    assert _mined(spark, rows, block_rows=4096, group_bytes=1500) == found


def test_hard_negatives_without_rows(spark):
    assert _mined(spark, []) == []
    assert _mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_score_beyond_a_long_ends_the_query(spark):
    with pytest.raises(Exception, match="does not fit 64 bits"):
        _mined(spark, [(100, [1e12], 1), (1, [1e12], 1), (2, [1e12], 2)])


@pytest.mark.parametrize("largest", [3, 2**20, 2**31, 2**70])
def test_packed_products_are_exact(largest):
    rng = random.Random(largest)
    number = lambda: float(rng.randint(-largest, largest))
    vectors = [np.array([number() for _ in range(rng.randrange(1, 9))]) for _ in range(50)]
    block = PackedBlock(vectors, largest)
    scorer = BlockScorer(block.n_rows, block.width, block.bias, block.fields)
    for _ in range(20):
        anchor = [rng.choice((int(number()), 0, largest, -largest)) for _ in range(rng.randrange(10))]
        expected = [sum(a * int(x) for a, x in zip(anchor, v, strict=False)) for v in vectors]
        assert scorer.score(anchor).tolist() == expected


def test_query_groups_hold_every_row_once_within_the_bound(spark):
    queries = spark.createDataFrame([(i % 7, 10 + i % 3) for i in range(200)] + [(1, 500)], "name long, wide long")
    groups = list(query_groups(queries, F.col("wide"), 400))
    assert sum(map(len, groups)) == 201 and len({r.number for g in groups for r in g}) == 201
    assert all(len(g) == 1 or sum(r.wide for r in g) <= 400 for g in groups)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranked(docs, items, k):
    counts = [(doc_id, Counter(_terms(text))) for doc_id, text in docs]
    counts = [(d, c) for d, c in counts if c]
    total, words, held = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 75 + 25 * c.total() * total // words
            score = sum(
                times * math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in Counter(_terms(text)).items()
                if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(str(item_id), rank + 1, str(d), -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _searched(spark, docs, items, **settings):
    clash = ["number", "n", "m", "key", "spread", "columns", "counts", "score", "rank"]
    extra = ", ".join(f"{c} string" for c in clash)
    frame = spark.createDataFrame([(*r, *["clash"] * len(clash)) for r in docs], f"doc_id long, text string, {extra}").repartition(4)
    asked = spark.createDataFrame([(*r, *["clash"] * len(clash)) for r in items], f"item_id long, text string, {extra}")
    found = lexical_search(frame, asked, **settings).collect()
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in found)


def _text_rows():
    rng = random.Random(13)
    words = [f"W{i}" for i in range(80)] + ["É", "é", "naïve", "x_y", "a-b", "日本", "don't", "\x00q", "z" * 300]
    weights = [1 / (i + 1) for i in range(len(words))]
    make = lambda n: rng.choice(" .,\n_\t").join(rng.choices(words, weights, k=n))
    docs = [(i, make(rng.randrange(1, 60))) for i in range(500)]
    docs += [(3, docs[3][1]), (900, docs[3][1]), (None, docs[3][1]), (None, docs[4][1]), (901, None), (902, ""), (903, "--- !"), (904, make(20_000))]
    items = [(i, make(rng.randrange(1, 12))) for i in range(30)]
    items += [items[0], (0, items[1][1]), (None, docs[3][1]), (40, None), (41, ""), (42, "unknownterm"), (43, " ".join(words)), (44, "W0 " * 5000)]
    return docs, items


def test_lexical_search_against_brute_force(spark):
    docs, items = _text_rows()
    expected = _ranked(docs, items, 20)
    assert _searched(spark, docs, items) == expected
    assert _searched(spark, docs, items, group_bytes=16_000, block_entries=4096) == expected
    assert _searched(spark, docs, items, k=3) == _ranked(docs, items, 3)


def test_lexical_search_without_rows(spark):
    docs, items = _text_rows()
    assert _searched(spark, [], items) == [] and _searched(spark, docs, []) == []
    assert _searched(spark, [(1, None), (2, "..")], items) == []


def test_a_ball_tree_prunes_and_misses_nothing():
    rng = np.random.default_rng(5)
    topics = [rng.choice(2000, 40, replace=False) for _ in range(20)]
    columns = [np.unique(rng.choice(topics[i // 200], 20)) for i in range(4000)]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])])
    values = rng.integers(1, 1_000_000, starts[-1])
    tree = BallTree(np.arange(4000), np.zeros(4000, bool), Rows(starts, np.concatenate(columns), values))
    scored = 0
    for topic in topics:
        query, times = np.sort(topic[:8]), np.arange(1, 9)
        best = Best(20)
        scored += tree.search(query, times, best)
        dense = np.zeros(2000, np.int64)
        dense[query] = times
        scores = np.add.reduceat(values * dense[np.concatenate(columns)], starts[:-1])
        order = np.lexsort((np.arange(4000), -scores))[:20]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert scored < 0.5 * 4000 * len(topics)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_lexical_search"])
def test_searches_against_sql(same_as_sql, name):
    same_as_sql(QUERIES[name], ORACLES[name])
