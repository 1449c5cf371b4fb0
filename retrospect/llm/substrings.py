"""Substring dedup: every word inside a passage that also occurs in a document with a smaller id is removed.

A window is `size` consecutive words. Documents lie in blocks of consecutive ids, so that of two blocks one holds the
smaller ids throughout.

1. Hashes of all windows go to hash buckets, with their block. A bucket finds the hashes that several blocks share
   and asks, for each block, the one before it among them for the text.
2. A block that is asked cuts the passages from its documents and sends them on: these confirm the recurrence by text.
3. Each block compiles phrases of the passages that it got, and of those that recur among its own documents, into
   Aho-Corasick automata (sharded to a bounded number of words each) and streams all its documents through them. The
   phrases tile a passage, short enough that every window holds one whole. Where one is located, the match is followed
   to both sides along the passage; a stretch of a window or more goes if the passage's first document is smaller.

Hashes only choose what to compare; words are removed where the automaton finds the same words. Memory of a task
is bounded by a bucket (about `bucket_bytes` of text) or a block (`block_docs` documents) with its passages.

Null text has no words. Rows with a null id have no order: they lose nothing and remove nothing. Rows that repeat an
id are documents of their own, of which none is smaller. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, word_count, words_of
from .hashing import Words, chunks_by_bytes, from_packed_sorted, from_planes, packed_sorted, planes

_SHARD_WORDS = 250_000
_HELD_WINDOWS = 1_000_000
#: Characters that stand for words in an automaton; 0 stands for all words outside of its phrases.
_SURROGATES = (0xD800, 0xE000)


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [t.encode() if t else b"" for t in frame["text"]]


def _windows(texts: list[bytes], size: int) -> Iterator[tuple[Words, int, np.ndarray, np.ndarray]]:
    """For chunks of texts: the words, the index of the first text, first words and hashes of the windows."""
    for part in chunks_by_bytes(texts):
        words = Words(texts[part])
        yield words, part.start, *words.windows(size)


def window_buckets(docs: DataFrame, size: int, bucket_bits: int) -> DataFrame:
    """bucket, hashes, blocks: the windows of every document, packed, each block's once in a lot of windows."""

    def packed(found: list[np.ndarray], homes: list[np.ndarray]) -> pd.DataFrame:
        hashes, blocks = np.concatenate(found), np.concatenate(homes)
        order = np.lexsort((blocks, hashes))
        hashes, blocks = hashes[order], blocks[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (blocks[1:] != blocks[:-1])
        hashes, blocks = hashes[new], blocks[new]
        bucket = hashes >> np.uint64(64 - bucket_bits)
        cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        rows = [
            (int(h[0] >> np.uint64(64 - bucket_bits)), packed_sorted(h), planes(b))
            for h, b in zip(np.split(hashes, cuts), np.split(blocks, cuts), strict=True)
            if len(h)
        ]
        return pd.DataFrame(rows, columns=["bucket", "hashes", "blocks"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block = batch["block"].to_numpy(np.int64)
            found, homes, held = [], [], 0
            for words, first, at, hashes in _windows(_texts(batch), size):
                found.append(hashes)
                homes.append(block[words.text[at] + first])
                held += len(hashes)
                if held >= _HELD_WINDOWS:  # what is sorted at once stays small, however long the texts of a batch
                    yield packed(found, homes)
                    found, homes, held = [], [], 0
            if held:
                yield packed(found, homes)

    return docs.select("block", "text").mapInPandas(scan, "bucket int, hashes binary, blocks binary")


def requests(_: tuple, bucket: pd.DataFrame) -> pd.DataFrame:
    """block, targets, hashes: windows whose text `block` is to send to the next block that shares their hash."""
    hashes = np.concatenate([from_packed_sorted(x) for x in bucket["hashes"]])
    blocks = np.concatenate([from_planes(x).view(np.int64) for x in bucket["blocks"]])
    order = np.lexsort((blocks, hashes))
    hashes, blocks = hashes[order], blocks[order]
    follows = np.flatnonzero((hashes[1:] == hashes[:-1]) & (blocks[1:] != blocks[:-1]))
    source, target, shared = blocks[follows], blocks[follows + 1], hashes[follows]
    order = np.lexsort((shared, target, source))
    source, target, shared = source[order], target[order], shared[order]
    cuts = np.flatnonzero(np.diff(source)) + 1
    rows = [
        (int(s[0]), planes(t), planes(h))
        for s, t, h in zip(np.split(source, cuts), np.split(target, cuts), np.split(shared, cuts), strict=True)
        if len(s)
    ]
    return pd.DataFrame(rows, columns=["block", "targets", "hashes"])


def _runs(words: Words, at: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
    """Text index and text of the passages that sorted windows form where they overlap or touch."""
    if len(at):
        breaks = np.flatnonzero((np.diff(at) > size) | (np.diff(words.text[at]) != 0)) + 1
        for run in np.split(at, breaks):
            yield int(words.text[run[0]]), words.data[words.start[run[0]] : words.end[run[-1] + size - 1]]


def passages_of_block(docs: pd.DataFrame, asked: pd.DataFrame, size: int) -> pd.DataFrame:
    """target, passage: the texts that other blocks are to compare with."""
    rows: list[tuple[int, bytes]] = []
    if len(docs) and len(asked):
        targets = np.concatenate([from_planes(x).view(np.int64) for x in asked["targets"]])
        hashes = np.concatenate([from_planes(x) for x in asked["hashes"]])
        order = np.argsort(hashes, kind="stable")
        targets, hashes = targets[order], hashes[order]
        open_ = np.ones(len(hashes), bool)  # each text is sent once, from the first chunk that has it
        for words, _, at, own in _windows(_texts(docs), size):
            first_own, first_at = np.unique(own, return_index=True)
            place = np.searchsorted(first_own, hashes)
            hit = open_ & (place < len(first_own))
            hit[hit] = first_own[place[hit]] == hashes[hit]
            open_ &= ~hit
            where, to = at[first_at[place[hit]]], targets[hit]
            order = np.lexsort((where, to))
            where, to = where[order], to[order]
            for group in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
                if len(group):
                    rows += [(int(to[group[0]]), text) for _, text in _runs(words, where[group], size)]
    return pd.DataFrame(rows, columns=["target", "passage"])


def _shards(passages: list[tuple[int, bytes]], size: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Passages as (rank of their first document, words), in lots of a bounded number of words."""
    lot, held = [], 0
    for rank, text in passages:
        words = text.split()
        for start in range(0, len(words) - size + 1, _SHARD_WORDS):
            part = words[start : start + _SHARD_WORDS + size - 1]
            lot.append((rank, part))
            held += len(part)
            if held >= _SHARD_WORDS:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


class PhraseAutomaton:
    """The phrases that tile some passages, for locating all of the passages' windows in texts."""

    def __init__(self, lot: list[tuple[int, list[bytes]]], size: int):
        import ahocorasick

        self.size, self.phrase = size, (size + 1) // 2
        self.codes: dict[bytes, str] = {}
        for _, part in lot:
            for w in part:
                if w not in self.codes:
                    code = len(self.codes) + 1
                    self.codes[w] = chr(code if code < _SURROGATES[0] else code - _SURROGATES[0] + _SURROGATES[1])
        self.passages = [(rank, "".join([self.codes[w] for w in part])) for rank, part in lot]
        homes: dict[str, list[tuple[int, int]]] = {}
        for number, (_, coded) in enumerate(self.passages):
            for at in range(0, len(coded) - self.phrase + 1, self.phrase):
                homes.setdefault(coded[at : at + self.phrase], []).append((number, at))
        self.automaton = ahocorasick.Automaton()
        for phrase, places in homes.items():
            self.automaton.add_word(phrase, places)
        self.automaton.make_automaton()

    def locate(self, words: list[bytes], rank: int) -> list[tuple[int, int]]:
        """Stretches (start, end) of words that lie in a passage of a smaller rank."""
        text = "".join([self.codes.get(w, "\0") for w in words])
        n, found, followed = len(text), [], {}
        for last, places in self.automaton.iter(text):
            start = last - self.phrase + 1
            for number, at in places:
                first, passage = self.passages[number]
                if first >= rank or followed.get((number, start - at), 0) > start:
                    continue
                left, back = start, at
                while left and back and text[left - 1] == passage[back - 1]:
                    left, back = left - 1, back - 1
                right, ahead, end = last + 1, at + self.phrase, len(passage)
                while right < n and ahead < end and text[right] == passage[ahead]:
                    right, ahead = right + 1, ahead + 1
                followed[number, start - at] = right
                if right - left >= self.size:
                    found.append((left, right))
        return found


def _local_passages(texts: list[bytes], ranks: np.ndarray, size: int) -> list[tuple[int, bytes]]:
    """Passages that several documents of a block share, with the rank of the smallest, from that document."""
    hashes, ranked, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
    chunks = []
    for words, first, at, own in _windows(texts, size):
        hashes.append(own)
        ranked.append(ranks[words.text[at] + first])
        place.append(np.stack([np.full(len(at), len(chunks)), at], axis=1))
        chunks.append(words)
    h, r, p = np.concatenate(hashes), np.concatenate(ranked), np.concatenate(place)
    order = np.lexsort((r, h))
    h, r, p = h[order], r[order], p[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    last = np.concatenate([start[1:], [len(h)]]).astype(np.int64) - 1 if len(h) else start
    shared = start[r[start] != r[last]] if len(h) else start
    out = []
    rank_of = {}
    for chunk, at, rank in zip(p[shared, 0].tolist(), p[shared, 1].tolist(), r[shared].tolist(), strict=True):
        rank_of.setdefault(chunk, []).append((at, rank))
    for chunk, found in rank_of.items():
        found.sort()
        words, where = chunks[chunk], np.array([a for a, _ in found], dtype=np.int64)
        ranks_at = dict(found)
        breaks = np.flatnonzero((np.diff(where) > 1) | (np.diff(words.text[where]) != 0)) + 1
        for run in np.split(where, breaks):
            out.append((ranks_at[int(run[0])], words.data[words.start[run[0]] : words.end[run[-1] + size - 1]]))
    return out


def dedup_block(docs: pd.DataFrame, sent: pd.DataFrame, size: int) -> pd.DataFrame:
    """doc_id, n_words, n_removed, kept for the documents of one block."""
    docs = docs.reset_index(drop=True)
    texts = _texts(docs)
    words = [t.split() for t in texts]
    known = docs["doc_id"].notna().to_numpy()
    # Ranks: 0 for what earlier blocks sent, then the block's ids in order.
    ranks = np.where(known, docs["doc_id"].rank(method="dense").fillna(0).to_numpy().astype(np.int64), 0)
    rank_texts = [t if k else b"" for t, k in zip(texts, known, strict=True)]
    passages = sorted({bytes(p) for p in sent["passage"]})
    located: list[list[tuple[int, int]]] = [[] for _ in texts]
    for lot in _shards(_local_passages(rank_texts, ranks, size) + [(0, p) for p in passages], size):
        phrases = PhraseAutomaton(lot, size)
        for i, own in enumerate(words):
            if ranks[i] and len(own) >= size:
                located[i] += phrases.locate(own, int(ranks[i]))
    rows = []
    for doc_id, own, stretches in zip(docs["doc_id"], words, located, strict=True):
        removed = 0
        kept = own
        if stretches:
            steps = np.zeros(len(own) + 1, np.int64)
            for start, end in set(stretches):
                steps[start] += 1
                steps[end] -= 1
            keep = np.cumsum(steps)[:-1] == 0
            kept = list(itertools.compress(own, keep.tolist()))
            removed = len(own) - len(kept)
        rows.append((doc_id, len(own), removed, b" ".join(kept).decode()))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})


def dedup_substrings(docs: DataFrame, size: int = 13, block_docs: int = 512, bucket_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row of docs."""
    ship_package(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocked = own.withColumn("block", F.floor(F.col("doc_id") / F.lit(block_docs)).cast("long"))
    total = blocked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bucket_bits = max(3, (total // bucket_bytes).bit_length())
    asked = window_buckets(blocked.filter("block is not null"), size, bucket_bits).groupBy("bucket").applyInPandas(requests, "block long, targets binary, hashes binary")
    known, loose = blocked.filter("block is not null"), blocked.filter("block is null")
    by_block = known.groupBy("block")
    passages = by_block.cogroup(asked.groupBy("block")).applyInPandas(
        lambda left, right: passages_of_block(left, right, size), "target long, passage binary"
    )
    done = by_block.cogroup(passages.groupBy("target")).applyInPandas(
        lambda left, right: dedup_block(left, right, size), "doc_id long, n_words long, n_removed long, kept string"
    )
    # Rows without an id are compared with none: a plain projection, not a group.
    untouched = loose.select("doc_id", word_count(F.col("text")).alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join(words_of(F.col("text")), " ").alias("kept"))
    return done.unionByName(untouched)
