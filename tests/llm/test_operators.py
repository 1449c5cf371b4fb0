"""Training-data operators against brute force on small tables with nulls, ties, repeats, long and empty texts."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from retrospect.llm.line_dedup import dedup_lines
from retrospect.llm.mixing import mix_sources, taken_copies
from retrospect.llm.ngram_join import document_sets, ngram_join
from retrospect.llm.packing import pack, pack_documents
from retrospect.llm.quality import kept_documents, quality_rules
from retrospect.llm.queries import ORACLES, QUERIES, tokenizer_path
from retrospect.llm.sharding import shard_by_bytes
from retrospect.llm.substrings import dedup_substrings
from retrospect.llm.token_rollup import TokenRollup
from retrospect.llm.topk import top_k
from retrospect.llm.urls import judge_urls, split_url

CLASHING = ("size", "key", "part", "row", "block", "low", "removed", "n_words")
SCHEMA = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)


def _corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["É", "the", "of"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = make(30), make(14)
    rows = []
    for i in range(60):
        text = f"{make(20)}\n{line if i % 3 == 0 else make(12)}\n{make(9)} {passage if i % 4 == 0 else ''}\n\n{make(8)}"
        rows.append((i, text, f"s{i % 3}" if i % 7 else None))
    copy = rows[5][1]
    near = copy.split()
    near[3] = "other"
    rows += [(60, copy, "s0"), (61, copy, "s0"), (62, " ".join(near), "s1"), (63, None, "s1"), (64, "", None), (65, " \n\t ", "s2")]
    rows += [(66, "one", "s2"), (67, "two words", "s2"), (68, make(6000), "s2"), (2, rows[2][1], rows[2][2]), (None, copy, "s0"), (None, None, None)]
    return rows


ROWS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "xx", *["clash"] * len(CLASHING)) for r in ROWS], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return (text or "").encode().split()


def test_sharding(docs, no_docs):
    rows = sorted(shard_by_bytes(docs, shards=7).collect(), key=lambda r: (r.shard, r.slot))
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(slots == list(range(len(slots))) for slots in by.values())
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    # Brute force: rows in order, each to the shard in whose equal share of bytes its middle byte lies.
    order = sorted(((-1 if i is None else i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _ in ROWS)
    total, at, expected = sum(size for _, _, size in order), 0, collections.Counter()
    for i, crc, size in order:
        expected[i, crc, min(6, (2 * at + size) * 7 // (2 * total))] += 1
        at += size
    assert collections.Counter((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.shard) for r in rows) == expected
    assert shard_by_bytes(no_docs).count() == 0


def test_shards_are_even(spark):
    rows = QUERIES["op5_sharding"](spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest")).collect()
    assert len(rows) == 40
    fair = sum(r.bytes for r in rows) / 40
    assert all(abs(r.bytes - fair) <= max(x.largest for x in rows) for r in rows)


def test_mixing(docs, no_docs):
    rows = mix_sources(docs).collect()
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((i, len(_words(t))) for i, t, _ in ROWS)
    total = collections.Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        total[r.source_size, r.target] += r.taken
    assert sum(target for _, target in total) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert all(abs(taken - target) < 1 and target <= 2 * size for (size, target), taken in total.items())
    again = {(r.doc_id, r.size): r.taken for r in mix_sources(docs).collect()}
    assert all(again[r.doc_id, r.size] == r.taken for r in rows)
    copies = taken_copies(mix_sources(docs, extra=(F.col("text"),)), F.col("text")).collect()
    assert sum(len(_words(c.copy_text)) for c in copies) == sum(r.taken for r in rows)
    assert mix_sources(no_docs).count() == 0


def _measures(text):
    words, text = _words(text), text or ""
    triples = list(zip(words, words[1:], words[2:]))
    counts = collections.Counter(triples)
    covered = {i + d for i, t in enumerate(triples) if counts[t] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, no_docs):
    rows = quality_rules(docs, min_docs=2, host_share=0.2, keep_share=0.5).collect()
    expected = sorted((str(i), *_measures(t)) for i, t, _ in ROWS)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == expected
    norm = lambda x: " ".join(x.lower().split())
    seen, hosts = collections.Counter(), collections.Counter(s for _, _, s in ROWS)
    for _, text, source in ROWS:
        seen.update({(source, norm(x)) for x in (text or "").split("\n") if norm(x)})
    frequent = {k for k, n in seen.items() if n > 2 and n > 0.2 * hosts[k[0]]}
    lost = sorted((str(i), sum(len(x.split()) for x in (t or "").split("\n") if (s, norm(x)) in frequent)) for i, t, s in ROWS)
    assert frequent and sorted((str(r.doc_id), r.n_boilerplate_words) for r in rows) == lost
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.n_words - r.n_boilerplate_words >= 0.5 * r.n_words)
    kept = kept_documents(docs, min_docs=2, host_share=0.2)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert quality_rules(no_docs).count() == 0


def test_kept_documents_lose_frequent_lines(docs):
    norm = lambda x: " ".join(x.lower().split())
    seen, hosts = collections.Counter(), collections.Counter(s for _, _, s in ROWS)
    for _, text, source in ROWS:
        seen.update({(source, norm(x)) for x in (text or "").split("\n") if norm(x)})
    frequent = {k for k, n in seen.items() if n > 2 and n > 0.2 * hosts[k[0]]}
    strip = lambda t, s: "\n".join(x for x in t.split("\n") if (s, norm(x)) not in frequent)
    texts = collections.Counter((str(i), strip(t or "", s)) for i, t, s in ROWS)
    rows = kept_documents(docs, min_docs=2, host_share=0.2).collect()
    ours = collections.Counter((str(r.doc_id), r.text) for r in rows)
    assert ours <= texts
    assert any(t != strip(t, s) for i, t, s in ROWS if i in {r.doc_id for r in rows})


def test_packing(docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["İstanbul ǅ e\u0301 Σας ſ", "C'EST l'été, don't!!", "naïve — “quote” ²³½", "日本 한국 mixed été"]
    extra = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = pack_documents(extra, path, capacity=512).collect()
    expected = collections.Counter()
    for doc_id, text in [(i, t) for i, t, _ in ROWS] + [(100 + i, t) for i, t in enumerate(texts)]:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k in range(-(-len(ids) // 512)):
            part = ids[512 * k : 512 * k + 512]
            expected[doc_id, k, 512 * k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= -(-sum(r.length for r in rows) // 512) * 1.2 + 1
    assert pack_documents(no_docs, path).count() == 0


def _packed_totals(lengths, capacity):
    """Tokens in each sequence after rounds of best fit, one gap after the other."""
    left, gaps, full = sorted(lengths), [], []
    while left:
        if not gaps:
            need = max(-(-sum(left) // capacity), sum(2 * n > capacity for n in left))
            gaps, left = [capacity - n for n in left[::-1][:need]], left[::-1][need:][::-1]
        pieces = collections.deque(left)
        pace, small, after = max(1, 2 * len(left) // len(gaps)), [], []
        for gap in sorted(gaps):
            while pieces and pieces[0] <= gap:
                small.append(pieces.popleft())
            fitting = [n for n in left if n <= gap]
            for _ in range(min(gap // fitting[-1], pace) if fitting else 0):
                gap -= small.pop() if small else 0
            after.append(gap)
        left = small + list(pieces)
        full += [gap for gap in after if left and gap < left[0]]
        gaps = [gap for gap in after if not left or gap >= left[0]]
    return sorted(capacity - gap for gap in full + gaps)


def _best_fit_decreasing(lengths, capacity):
    """Sequences that best fit opens when it places one piece after the other, the longest first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        gap = min((g for g in gaps if g >= n), default=None)
        if gap is not None:
            gaps.remove(gap)
        gaps.append((capacity if gap is None else gap) - n)
    return len(gaps)


@pytest.mark.parametrize("kind", ["drawn", "one length", "single tokens", "long", "hot and single", "middle", "none"])
def test_best_fit_rounds(spark, kind):
    rng = random.Random(3)
    lengths = {
        "drawn": [min(100, int(rng.expovariate(0.04)) + 1) for _ in range(1500)],
        "one length": [30] * 400,
        "single tokens": [1] * 950,
        "long": [rng.randint(51, 100) for _ in range(200)],
        "hot and single": [34] * 300 + [1] * 500 + [rng.randint(1, 100) for _ in range(200)],
        "middle": [rng.randint(20, 40) for _ in range(800)],
        "none": [],
    }[kind]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank string, row string"
    # Every fifth row has no id, and many repeat each other.
    pieces = [(None if i % 5 == 0 else i // 2, 0, 0, n, 7, "clash", "clash") for i, n in enumerate(lengths)]
    rows = pack(spark.createDataFrame(pieces, schema), 100).collect()
    assert collections.Counter(tuple(r)[:7] for r in rows) == collections.Counter(pieces)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100
    assert sorted(sum(n for _, n in parts) for parts in sequences.values()) == _packed_totals(lengths, 100)
    assert len(sequences) <= 1.05 * _best_fit_decreasing(lengths, 100)


@pytest.mark.parametrize("block", [8, 1024])
def test_substrings(docs, no_docs, block):
    size = 5
    first, rows = {}, []
    known = sorted([r for r in ROWS if r[0] is not None], key=lambda r: r[0])
    for i, text, _ in known:
        words = _words(text)
        for k in range(len(words) - size + 1):
            first.setdefault(tuple(words[k : k + size]), i)
    for i, text, _ in ROWS:
        words = _words(text)
        gone = [False] * len(words)
        for k in range(len(words) - size + 1 if i is not None else 0):
            if first[tuple(words[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        rows.append((str(i), len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    ours = dedup_substrings(docs, size=size, block_docs=block, bucket_bytes=1 << 12).collect()
    assert sum(r[2] for r in rows) > 0
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in ours) == sorted(rows)
    assert dedup_substrings(no_docs).count() == 0


def _components(sets, percent):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("n", "percent", "cell"), [(3, 90, 512), (3, 60, 2), (5, 80, 512)])
def test_ngram_join(docs, no_docs, n, percent, cell):
    sets = {}
    for i, text, _ in ROWS:
        words = [w.lower() for w in _words(text)]
        grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
        if i is not None:
            sets[i] = grams
    roots = _components(sets, percent)
    rows = ngram_join(docs, n=n, percent=percent, cell_items=cell, bucket_bytes=1 << 12).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), roots[r.doc_id])
    assert len(set(roots.values())) < len(roots)
    assert ngram_join(no_docs).count() == 0


@pytest.mark.parametrize(
    "texts", [[None, "", " \n\t "], [None, None], ["", "a b c d"], ["long " * 120_000, "", None, " "], ["a b c d", "long " * 120_000, "", ""]]
)
def test_document_sets_of_chunks_without_words(spark, texts):
    frame = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 1), "doc_id long, text string")
    rows = sorted(document_sets(frame, 3).filter("chunk is null").collect(), key=lambda r: r.doc_id)
    sets = [set(zip(words, words[1:], words[2:])) for words in map(_words, texts)]
    assert [(r.doc_id, r.n_shingles) for r in rows] == [(i, len(s)) for i, s in enumerate(sets)]
    assert all(bool(r.bitmap) for r in rows if r.n_shingles)


@pytest.mark.parametrize("cell", [2, 2048])
def test_line_dedup(docs, no_docs, cell):
    seen, gone = [], collections.defaultdict(set)
    known = sorted({(i, t) for i, t, _ in ROWS if i is not None and t is not None})
    for i, text in known:
        for k, line in enumerate(text.split("\n")):
            words = frozenset(line.encode().split())
            if words:
                if any(100 * len(words & y) >= 70 * len(words | y) for y in seen):
                    gone[i].add(k)
                seen.append(words)
    rows = dedup_lines(docs, percent=70, cell_items=cell, bucket_bytes=1 << 12)
    assert rows.columns == [*docs.columns, "line_dedup"]
    text = {i: t for i, t in known}
    expected = []
    for i, t, _ in ROWS:
        lines = [] if t is None else t.split("\n")
        drop = gone[i] if i is not None and t is not None else set()
        expected.append((str(i), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), len(drop)))
    assert gone and text
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.doc_id), r.text, r.line_dedup.n_lines, r.line_dedup.n_removed) for r in rows.collect()), key=key) == sorted(expected, key=key)
    assert dedup_lines(no_docs).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(90, 6)), 1)
    vectors[10:40] = vectors[10]
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(vectors)]
    rows += [(90, None, "c"), (91, [1.0, None], "c"), (92, [float("nan")] * 6, "c"), (93, [float("inf")] * 6, "c"), (None, [1.0] * 6, "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    ints = np.floor(np.array([v for v in vectors.astype(np.float32)], dtype=float) * 1024).astype(np.int64)
    found = top_k(frame, F.col("vec_id") % 10 == 0, k=7, block_rows=25, query_rows=3).collect()
    by = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    assert sorted(by) == list(range(0, 90, 10))
    for q, hits in by.items():
        score = ints @ ints[q]
        order = [i for i in np.lexsort((np.arange(90), -score)).tolist() if i != q][:7]
        assert hits == [(i, int(score[i])) for i in order]
    assert top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_top_k_of_long_vectors(spark):
    """Vectors whose squares pass 63 bits are scored exactly; only a score that no long can hold ends the query."""
    rows = [(0, [1e30, 3.0]), (1, [0.0, 2.5]), (2, [1e6, -1.0]), (3, [-1e6, 0.0]), (4, [-1e38, 5.0]), (5, [7.0, 4e9]), (6, [0.0, 2e12]), (10, []), (11, [3e12, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(q[a], q[b]))
    for asked in (1, 10):
        found = top_k(frame, F.col("vec_id") == asked, k=9, block_rows=64).orderBy("rank").collect()
        expected = sorted(((i, score(asked, i)) for i in q if i != asked), key=lambda pair: (-pair[1], pair[0]))
        assert [(r.vec_id, r.score) for r in found] == expected
    found = top_k(frame.filter("vec_id in (2, 3, 5, 10)"), F.col("vec_id") == 5, k=9).orderBy("rank").collect()  # a long query, short rows
    assert [(r.vec_id, r.score) for r in found] == sorted(((i, score(5, i)) for i in (2, 3, 10)), key=lambda pair: -pair[1])
    with pytest.raises(Exception, match="does not fit 64 bits"):
        top_k(frame, F.col("vec_id") == 2, k=5).collect()


def test_hot_lines_are_paired_in_pieces(docs):
    """One word that very many lines share is dealt to pieces: the same lines go."""
    lines = lambda n: sorted((str(r.doc_id), r.text or "") for r in dedup_lines(docs, percent=70, bucket_bytes=1 << 12, hot_lines=n).collect())
    assert lines(3) == lines(16_384)


def test_hot_shingles_are_paired_in_pieces(docs):
    groups = lambda n: sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join(docs, n=3, percent=60, hot_sets=n).collect())
    assert groups(3) == groups(16_384)


def test_columns_named_as_the_results(spark):
    frame = spark.createDataFrame([(1, "a b c d\na b c d", "s", "x")], "doc_id long, text string, source string, line_dedup string")
    assert dedup_lines(frame, result="counts").columns == ["doc_id", "text", "source", "line_dedup", "counts"]


def test_urls(spark):
    urls = ["HTTP://A.Org/x?y#z", "nothing", None, "http://EXAMPLE.org/es/1", "http://b.com/fr/", "http://b.com/de/q", "http://c.net", "://h/p://q", "http://org"]
    frame = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, score string")
    host, path = split_url(F.col("url"))
    parts = {r[0]: (r[1], r[2]) for r in frame.select("page_id", host, path).collect()}
    assert parts[0] == ("a.org", "/x") and parts[1] == parts[2] == ("", "") and parts[7] == ("h", "/p://q")
    judged = {r.page_id: (r.rule, r.verdict) for r in judge_urls(frame).collect()}
    assert judged[0] == ("org/", "allow") and judged[3] == ("example.org/es/", "block") and judged[4] == ("com/fr/", "allow")
    assert judged[5] == ("com/de/", "block") and judged[8][0] is None and len(judged) == len(urls)
    assert judge_urls(frame.limit(0)).count() == 0


def test_url_models_separate_held_out_urls(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        good = i % 2 == 0
        slug = "".join(rng.choice("aeiou" if good else "xzqvk") for _ in range(12))
        rows.append((i, f"http://site.{'org' if i % 4 < 2 and good else 'net'}/{'de' if not good else 'en'}/{slug}"))
    rows += [(1000 + i, f"http://m.com/{'fr' if i % 2 == 0 else 'de'}/" + "".join(rng.choice("aeiou" if i % 2 == 0 else "xzqvk") for _ in range(12))) for i in range(200)]
    judged = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).filter("rule is null").collect()
    right = [(r.verdict == "allow") == (r.page_id % 2 == 0) for r in judged]
    assert sum(right) >= 0.9 * len(right)


def test_rollup(spark):
    rollup = TokenRollup(spark)
    schema = "source string, lang string, tokenizer string, change string, tokens long, old_tokens long, extra int"
    load = spark.createDataFrame([("a", "en", "t", "insert", 5, None, 1), ("a", "en", "t", "insert", 7, None, 1), (None, None, "t", "insert", None, None, 1)], schema)
    later = spark.createDataFrame([("a", "en", "t", "revise", 9, 7, 1), (None, None, "t", "delete", None, 0, 1)], schema)
    assert rollup.commit("1", load) and not rollup.commit("1", load) and rollup.commit("1", load, again=True)
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted([("a", "en", "t", 2, 12), (None, None, "t", 1, 0)], key=str)
    assert rollup.commit("2", later) and rollup.commit("3", later.limit(0))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 2, 14)]
    assert not rollup.commit("3", later)  # an empty batch is committed too
    small = rollup.compacted()
    assert [tuple(r) for r in small.totals().collect()] == [("a", "en", "t", 2, 14)]
    assert not small.commit("2", later) and not small.commit("3", later)
    assert small.commit("4", later.filter("change = 'revise'")) and small.totals().first().tokens == 16


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_queries_without_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_substring_dedup"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    clean = [r for r in rows if not r.n_removed]
    assert all(r.kept_sha256 == hashlib.sha256(b" ".join(_words(texts[r.doc_id]))).hexdigest() for r in clean)
    gone = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    counted = QUERIES["op7_token_counts"](spark, sf_dir).filter("tokenizer = 'words-1'").agg(F.sum("tokens"), F.sum("docs")).first()
    assert tuple(counted) == (sum(len(_words(t)) for i, t in texts.items() if i not in gone), sum(i not in gone for i in texts))


def test_byte_token_totals(spark):
    """Totals of the byte-level vocabulary against its library, by source and language."""
    import public_tokenizers
    from retrospect.llm.tokens import byte_encoding

    sf_dir = "/root/testdata/sf0.001"
    encode = byte_encoding(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    gone = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    expected = collections.defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        if r.doc_id not in gone:
            expected[r.source, r.lang][0] += 1
            expected[r.source, r.lang][1] += len(encode(r.text or ""))
    rows = QUERIES["op7_token_counts"](spark, sf_dir).filter("tokenizer = 'byte_bpe_50k-1'").collect()
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in rows} == dict(expected)
