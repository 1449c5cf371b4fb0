"""Every stage over its whole input against brute force, on rows with nulls, repeats, ties, empty texts and clashing columns."""

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = ("line_dedup", "__text", "size", "key", "row", "left", "lines", "kept", "root")
SCHEMA = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def _rows():
    rng = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    footer, banner = make(9), make(12)
    rows = []
    for i in range(48):
        text = f"{banner if i % 2 == 0 else make(12)}\n{make(30)}\n{make(25)}\n{footer}"
        rows.append((i, text, f"s{i % 3}" if i % 8 else None))
    copy = rows[4][1]
    near = copy.split(" ")
    near[20] = "changed"
    rows += [(48, copy, "s0"), (49, " ".join(near), "s1"), (50, copy, "s2"), (51, None, "s1"), (52, "", "s1"), (53, " \n\t ", None), (54, "few words", "s0")]
    rows += [(55, "again and again " * 40, "s1"), (56, make(9000), "s2"), (3, rows[3][1], rows[3][2]), (None, make(80), "s0"), (None, None, None)]
    return rows


ROWS = _rows()


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), *["clash"] * len(CLASHING)) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, ROWS).cache()


def _words(text):
    return (text or "").encode().split()


def _taken(frame):
    return collections.Counter((r.doc_id, r.text, r.source) for r in frame.collect())


def test_quality_rules(spark, docs):
    norm = lambda x: " ".join(x.lower().split())
    seen, hosts = collections.Counter(), collections.Counter(s for _, _, s in ROWS)
    for _, text, source in ROWS:
        seen.update({(source, norm(x)) for x in (text or "").split("\n") if norm(x)})
    common = {k for k, n in seen.items() if n > 10 and n > 0.1 * hosts[k[0]]}
    expected = collections.Counter()
    for i, text, source in ROWS:
        words = _words(text)
        triples = list(zip(words, words[1:], words[2:]))
        counts = collections.Counter(triples)
        repeated = {k + d for k, t in enumerate(triples) if counts[t] > 1 for d in range(3)}
        lines = (text or "").split("\n")
        lost = sum(len(x.split()) for x in lines if (source, norm(x)) in common)
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and len(words) - lost >= 0.5 * len(words):
            expected[i, "\n".join(x for x in lines if (source, norm(x)) not in common), source] += 1
    kept = STAGES["quality rules"](spark, docs, None)
    assert kept.columns == docs.columns and _taken(kept) == expected
    assert common and all(r.n_chars == len(r.text) for r in kept.collect())


def test_line_dedup(spark, docs):
    order = sorted({(i, t) for i, t, _ in ROWS if i is not None and t is not None})
    earlier, gone = [], collections.defaultdict(set)
    for i, text in order:
        for k, line in enumerate(text.split("\n")):
            own = frozenset(_words(line))
            if own:
                if any(100 * len(own & y) >= 80 * len(own | y) for y in earlier):
                    gone[i, text].add(k)
                earlier.append(own)
    left = lambda i, t: t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
    found = STAGES["line dedup"](spark, docs, None)
    assert found.columns == docs.columns
    assert _taken(found) == collections.Counter((i, left(i, t), s) for i, t, s in ROWS)
    assert any(gone.values())


def test_one_of_each_group(spark, docs):
    sets = {}
    for i, text, _ in ROWS:
        words = [w.lower() for w in _words(text)]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {k: new if v == old else v for k, v in up.items()}
    expected = collections.Counter(i for i, t, _ in ROWS if i is None or not sets[i])
    expected.update({i for i in ids if sets[i] and up[i] == i})
    found = STAGES["n-gram jaccard join"](spark, docs, None)
    assert found.columns == docs.columns and collections.Counter(r.doc_id for r in found.collect()) == expected
    assert any(up[i] != i for i in ids)


def test_mixing(spark, docs):
    found = STAGES["source mixing"](spark, docs, None)
    rows = found.collect()
    assert found.columns == docs.columns and all(r.n_chars == len(r.text) for r in rows)
    sizes = collections.Counter()
    for _, text, source in ROWS:
        sizes[source] += len(_words(text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    total = 1.5 * sum(sizes.values())
    while open_:  # what is over a source's cap goes to the others by weight
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        target.update({s: 2 * sizes[s] for s in over} if over else {s: level * weight[s] for s in open_})
        open_ = open_ - over if over else set()
    taken, whole = collections.Counter(), collections.Counter()
    for r in rows:
        taken[r.source] += len(_words(r.text))
    assert all(abs(taken[s] - target[s]) < 1 for s in names)
    texts = {(i, s): [w.decode() for w in _words(t)] for i, t, s in ROWS if i is not None}
    for r in rows:
        if r.doc_id is not None:
            own = r.text.split()
            assert own == texts[r.doc_id, r.source][: len(own)]
            whole[r.doc_id] += len(own)
    assert all(n <= 2 * sum(len(_words(t)) for j, t, _ in ROWS if j == i) for i, n in whole.items())


def test_packing(spark, docs):
    from retrospect.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected = collections.Counter()
    for i, text, _ in ROWS:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        expected.update((i, k, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    rows = STAGES["best-fit packing"](spark, docs, None).collect()
    assert collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == expected
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, None, "s"), (2, "", "s"), (2, "", "s"), (3, " \n ", None)]])
def test_tables_without_words(spark, rows):
    given = _frame(spark, rows)
    for label, stage in corpus_pipeline.STAGES:
        found = stage(spark, given, None).collect()
        assert len(found) == {"quality rules": 0, "source mixing": 0}.get(label, len(rows))


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and found.filter(F.col("sequence_id").isNull()).count() == 0
