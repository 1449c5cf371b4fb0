"""The streaming transducer against the tokenizers library, in small windows and chunks, and the decoder in steps."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from retrospect.llm.bpe import _NEWER_LETTERS, _NEWER_NUMBERS, StreamingDecoder, StreamingEncoder, decode_ids, encode_texts, sufficient_lookahead, token_bytes
from retrospect.llm.queries import QUERIES, tokenizer_path

PIECES = ["a", "b", "e", " ", "  ", "\n", "1", "23", "!", "'s", "'re", "'", "é", "ß", "日本", "🙂", "<|endoftext|>", "<|endof", "́", " ", " "]
PIECES += ["\U00010d40", "\U00016d40", "Ᲊ", "\x1c", "\x85", "th", "the", " the", "ing", "----", "aaaaaaaaaa"]


@pytest.fixture(scope="module")
def path():
    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_padding()
    made.no_truncation()
    return made


def _texts():
    rng = random.Random(3)
    out = ["", "<|endoftext|>", "<|endoftext|><|endoftext|> "]
    out += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(600)]
    for piece in ["a", "ab", "-", "=", "  ", "\n", "\t ", "1", "é", "日", "the", "ing", "🙂", "!?", " "]:
        out += [piece * n for n in (50, 1000, 9000)]
        out += [f"'{piece * 3000}'re {piece * 500} 's", f"{' ' * 5000}{piece * 2000} b"]
    for _ in range(20):
        some = rng.sample(["a", "b", "e", "th", "he", "in", "er", "an", "re", "on", "o", "r", "s", "t"], rng.randrange(1, 6))
        out.append("".join(rng.choice(some) for _ in range(rng.randrange(1000, 9000))))
    return out


def _ids(rows):
    return [np.frombuffer(row, np.uint32).tolist() for row in rows]


@pytest.mark.parametrize(("window", "chunk"), [(8192, 1 << 20), (150, 97), (64, 5000)])
def test_ids_equal_the_library(path, library, window, chunk):
    texts = _texts()
    coded = StreamingEncoder(path, window, chunk).encode(texts)
    assert _ids(coded) == [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_is_cut_as_in_the_library(path, library):
    assigned = lambda c: c % 101 == 0 or unicodedata.category(chr(c)) not in ("Cn", "Co")
    newer = {c for a, b in (*_NEWER_LETTERS, *_NEWER_NUMBERS) for c in range(a - 1, b + 2)}
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c in newer or assigned(c))]
    texts = ["".join(f"a{c} 1{c} !{c}x {c} " for c in points[at : at + 4000]) for at in range(0, len(points), 4000)]
    assert _ids(StreamingEncoder(path).encode(texts)) == [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]


def test_lookahead_of_small_merge_lists():
    assert sufficient_lookahead([]) == 0
    assert sufficient_lookahead([("a", "b"), ("c", "d")]) == 1
    assert sufficient_lookahead([("b", "c"), ("a", "b")]) == 2  # a, b and bc: what follows b decides on a
    assert sufficient_lookahead([("a", "b"), ("b", "c")]) == 1
    assert sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3


def test_decoding_in_steps_equals_the_library(path, library):
    rng, table = random.Random(4), token_bytes(path)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(30))]
        cut, machine = rng.randrange(31), StreamingDecoder(table)
        assert machine.feed(ids[:cut]) + machine.feed(ids[cut:], True) == library.decode(ids, skip_special_tokens=False)
    machine = StreamingDecoder(table)
    assert machine.feed([table.index(b"\xc3"), 10**6, -1]) == "" and machine.feed([], True) == "�"


def test_round_trip_of_a_table(spark, path, library):
    texts = [*_texts()[::9], None, "", "x" * 300_000, "a <|endoftext|> b", "a <|endoftext|> b"]
    rows = [(i if i % 5 else None, t, "clash", "clash") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").repartition(3)
    found = decode_ids(encode_texts(frame, path), path, step=100).collect()
    expected = [c.ids for c in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    order = lambda row: (str(row[0]), str(row[2]), row[1])
    wanted = [(r[0], ids, r[1] or "") for r, ids in zip(rows, expected, strict=True)]
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in found), key=order) == sorted(wanted, key=order)
    assert decode_ids(encode_texts(frame.limit(0), path), path).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6])], "doc_id long, ids array<int>")
    assert [r.text for r in decode_ids(odd, path).orderBy("doc_id").collect()] == ["", "", ""]


def test_query_digests(spark, library):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf_dir}/documents.parquet'").fetchall()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for (doc_id, _), coded in zip(docs, library.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        decoded = library.decode(coded.ids, skip_special_tokens=False)
        expected.append((doc_id, len(coded.ids), digest(",".join(map(str, coded.ids))), digest(decoded)))
    assert sorted(map(tuple, QUERIES["op12_bpe_round_trip"](spark, sf_dir).collect())) == sorted(expected)
