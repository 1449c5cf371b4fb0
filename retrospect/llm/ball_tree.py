"""Exact top-k of lexical scores as inner products, searched in sparse ball trees.

A score is the sum, over a query's terms, of whole-number weights of the document's terms, so it is the inner product
of the query's term counts and a sparse document vector. Documents that share their heaviest term are dealt to the same
blocks (range-partitioned, spread by a hash, so that no term is one task's work). Each block is halved again and again
along the line between two distant documents; a node keeps the centroid of its documents and the radius around it.
For a query q and a node of centroid c and radius r no document's score exceeds q.c + |q| r, where q is cut to the
terms that occur in the node. Bounds are in doubles and enlarged by more than their rounding errors; a node whose bound
is below the k-th score found so far is pruned, the others are opened best first, and leaves score their documents in
64-bit integers. A task keeps the k best documents of each query over all its blocks.

Queries come in groups of bounded size (`query_groups`). Document vectors hold the group's terms only, which are all
that its scores need; document counts, lengths and frequencies are of all documents and whole texts.

Null or empty texts, and texts without terms, count for nothing and are found by no query. Documents that repeat an id
are documents of their own; a null id comes after all others among equal scores. Query rows are ranked each, those that
repeat an id as well; queries without known terms, and empty tables, give no rows. Terms and texts may have any length;
scores have to fit 64 bits (a query of over two hundred million terms might pass that). Other columns of either table
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, shuffle_partitions, staged
from .query_groups import query_groups

#: A byte's place in a term: ASCII letters and digits and all bytes of other characters; capitals A-Z are lowered.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_VECTOR = "doc_id long, n long, columns binary, counts binary"
_PLACED = "key int, spread long, doc_id long, m long, columns binary, counts binary"
_FOUND = "number long, doc_id long, score long"
_ROUNDING = 2.0**-40


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split() if text else []


def term_counts(text: str | None) -> Counter:
    return Counter(terms(text))


def document_vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms of the whole text), columns and counts of the vocabulary's terms, ascending; n above 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column_of = vocabulary.value
        for batch in batches:
            ids, ns, columns, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = term_counts(text.as_py())
                if own:
                    known = sorted((column_of[t], c) for t, c in own.items() if t in column_of)
                    ids.append(doc_id)
                    ns.append(own.total())
                    columns.append(np.array([c for c, _ in known], np.int32).tobytes())
                    counts.append(np.array([c for _, c in known], np.int32).tobytes())
            arrays = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(columns, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "columns", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, _VECTOR)


def document_frequencies(vectors: DataFrame, n_columns: int) -> DataFrame:
    """position and df: in how many documents each column occurs, summed in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_columns, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("columns").to_pylist()), np.int32)
            total += np.bincount(held, minlength=n_columns)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["position", "df"])

    return vectors.select("columns").mapInArrow(count, "position long, df long").groupBy("position").agg(F.sum("df").alias("df"))


def term_weights(frequencies: dict[int, int], n_columns: int, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequencies.get(c, 0) + 1))) for c in range(n_columns)], np.int64)


def _values(columns: np.ndarray, counts: np.ndarray, m: np.ndarray | int, weights: np.ndarray) -> np.ndarray:
    tf = counts.astype(np.int64)
    return weights[columns] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def placed_vectors(vectors: DataFrame, weights, n_docs: int, n_terms: int, b: int) -> DataFrame:
    """Vectors with m, their heaviest column as key, and spread, which sets the rows of one key apart."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, spread, ms = [], [], []
            for n, columns, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "columns", "counts")), strict=True):
                m = 100 - b + (b * n * n_docs) // n_terms
                own = np.frombuffer(columns, np.int32)
                keys.append(int(own[_values(own, np.frombuffer(counts, np.int32), m, weights.value).argmax()]))
                spread.append(row)
                ms.append(m)
                row += 1
            arrays = [pa.array(keys, pa.int32()), pa.array(spread, pa.int64()), batch.column("doc_id"), pa.array(ms, pa.int64())]
            names = ["key", "spread", "doc_id", "m", "columns", "counts"]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("columns"), batch.column("counts")], names=names)

    return vectors.filter(F.length("columns") > 0).mapInArrow(place, _PLACED).withColumn("spread", F.xxhash64("spread"))


class Rows:
    """Sparse rows: `starts` has one entry more than there are rows."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.starts, self.columns, self.values = starts, columns, values

    def taken(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[order]
        starts = np.concatenate([[0], sizes.cumsum()])
        at = np.repeat(self.starts[order] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(starts, self.columns[at], self.values[at])

    def dot(self, dense: np.ndarray, first: int, last: int) -> np.ndarray:
        """Inner products of the rows first to last - 1, none of them empty, with a dense vector."""
        low, high = self.starts[first], self.starts[last]
        return np.add.reduceat(self.values[low:high] * dense[self.columns[low:high]], self.starts[first:last] - low)


class BallTree:
    """A ball tree over documents: ids, which of them are null, and sparse rows of whole numbers, none of them empty."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, rows: Rows, leaf: int = 128):
        self.known, local = np.unique(rows.columns, return_inverse=True)  # columns are those of the block from here on
        rows = Rows(rows.starts, local.astype(np.int32), rows.values)
        self.real = Rows(rows.starts, rows.columns, rows.values.astype(np.float64))
        order, self.nodes = np.arange(len(ids)), []
        self._split(order, 0, leaf)
        self.ids, self.null, self.rows = ids[order], null[order], rows.taken(order)

    def _split(self, order: np.ndarray, first: int, leaf: int) -> int:
        """Add the node of the documents `order` (sorted in place), which start at `first`; its number."""
        own, width = self.real.taken(order), len(self.known)
        n = len(order)
        centre = np.bincount(own.columns, own.values, width) / n
        held = np.flatnonzero(centre)
        squares = np.add.reduceat(own.values**2, own.starts[:-1])
        apart = squares - 2 * own.dot(centre, 0, n) + centre @ centre
        radius = math.sqrt(max(0.0, apart.max()) + _ROUNDING * (squares.max() + centre @ centre))
        number = len(self.nodes)
        self.nodes.append([first, first + n, -1, -1, held, centre[held], radius])
        if n > leaf:
            dense = lambda i: np.bincount(own.columns[own.starts[i] : own.starts[i + 1]], own.values[own.starts[i] : own.starts[i + 1]], width)
            far = dense(int(apart.argmax()))
            other = dense(int((squares - 2 * own.dot(far, 0, n)).argmax()))
            side = np.argsort(own.dot(far - other, 0, n), kind="stable")
            order[:] = order[side]
            half = n // 2
            self.nodes[number][2] = self._split(order[:half], first, leaf)
            self.nodes[number][3] = self._split(order[half:], first + half, leaf)
        return number

    def _bound(self, node: int, columns: np.ndarray, counts: np.ndarray) -> float:
        """No document of the node has a higher score."""
        _, _, _, _, held, centre, radius = self.nodes[node]
        at = np.minimum(np.searchsorted(held, columns), len(held) - 1)
        there = held[at] == columns
        some = counts[there]
        return (float(some @ centre[at[there]]) + math.sqrt(float(some @ some)) * radius) * (1 + _ROUNDING) + 1

    def search(self, columns: np.ndarray, counts: np.ndarray, best: Best) -> int:
        """Give `best` what this tree has for a query of these columns and counts; how many documents were scored."""
        at = np.minimum(np.searchsorted(self.known, columns), len(self.known) - 1)
        there = self.known[at] == columns
        local, whole = at[there], counts[there]
        if not len(local):
            return 0
        real, dense, scored = whole.astype(np.float64), np.zeros(len(self.known), np.int64), 0
        dense[local] = whole
        heap = [(-self._bound(0, local, real), 0)]
        while heap and -heap[0][0] >= best.least:
            node = heapq.heappop(heap)[1]
            first, last, left, right = self.nodes[node][:4]
            if left < 0:
                best.add(self.rows.dot(dense, first, last), self.ids[first:last], self.null[first:last])
                scored += last - first
            else:
                for child in (left, right):
                    bound = -self._bound(child, local, real)
                    if -bound >= best.least:
                        heapq.heappush(heap, (bound, child))
        return scored


class Best:
    """The k best (score, id) of a query so far; `least` is the lowest score that may still enter."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        may = scores >= self.least
        if may.any():
            scores, ids, null = (np.concatenate(p) for p in ((self.scores, scores[may]), (self.ids, ids[may]), (self.null, null[may])))
            first = np.lexsort((ids, null, -scores))[: self.k]
            self.scores, self.ids, self.null = scores[first], ids[first], null[first]
            if len(first) == self.k:
                self.least = int(self.scores[-1])


def _blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, most: int) -> Iterator[BallTree]:
    """Trees of at most `most` entries and as many documents as that has 128ths, of rows as they come."""
    waiting: list[tuple] = []
    entries = 0

    def tree() -> BallTree:
        ids, ms, columns, counts = zip(*waiting, strict=True)
        sizes = np.array([len(c) // 4 for c in columns])
        columns, counts = (np.frombuffer(b"".join(x), np.int32) for x in (columns, counts))
        values = _values(columns, counts, np.repeat(np.array(ms, np.int64), sizes), weights)
        null = np.array([i is None for i in ids])
        return BallTree(np.array([i or 0 for i in ids], np.int64), null, Rows(np.concatenate([[0], sizes.cumsum()]), columns, values))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "m", "columns", "counts")), strict=True):
            if waiting and (entries + len(row[2]) // 4 > most or len(waiting) >= most // 128):
                yield tree()
                waiting, entries = [], 0
            waiting.append(row)
            entries += len(row[2]) // 4
    if waiting:
        yield tree()


def search_trees(placed: DataFrame, asked, weights, k: int, partitions: int, block_entries: int) -> DataFrame:
    """number, doc_id, score: each task's k best documents of each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: Best(k) for number, _, _ in asked.value}
        for tree in _blocks(batches, weights.value, block_entries):
            for number, columns, counts in asked.value:
                tree.search(columns, counts, best[number])
        numbers = np.repeat(np.array([*best], np.int64), [len(b.ids) for b in best.values()])
        joined = lambda name, kind: np.concatenate([np.zeros(0, kind), *(getattr(b, name) for b in best.values())])
        ids = pa.array(joined("ids", np.int64), mask=joined("null", bool))
        yield pa.RecordBatch.from_arrays([pa.array(numbers), ids, pa.array(joined("scores", np.int64))], names=["number", "doc_id", "score"])

    dealt = placed.repartitionByRange(partitions, "key", "spread").sortWithinPartitions("key", "spread")
    return dealt.select("doc_id", "m", "columns", "counts").mapInArrow(search, _FOUND)


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 20, b: int = 25, group_bytes: int = 4 << 20, block_entries: int = 1 << 19, task_docs: int = 1 << 16
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs (doc_id, text) for each row of items (item_id, text)."""
    spark = docs.sparkSession
    ship_package(spark)
    found = []
    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for group in query_groups(given, F.lit(64) + F.octet_length(F.coalesce(F.col("text"), F.lit(""))), group_bytes):
        counted = [(row.number, row.item_id, term_counts(row.text)) for row in group]
        column_of = {t: c for c, t in enumerate(sorted(set().union(*(c for _, _, c in counted))))}
        if not column_of:
            continue
        vocabulary = spark.sparkContext.broadcast(column_of)
        vectors = staged(document_vectors(docs, vocabulary), "term-counts")
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequencies = {row.position: row.df for row in document_frequencies(vectors, len(column_of)).collect()}  # of the group's terms
        weights = spark.sparkContext.broadcast(term_weights(frequencies, len(column_of), n_docs))
        asked = []
        for number, _, own in counted:
            pairs = sorted((column_of[t], c) for t, c in own.items())
            asked.append((number, np.array([c for c, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int64)))
        asked = spark.sparkContext.broadcast(asked)
        placed = placed_vectors(vectors, weights, n_docs, max(1, n_terms), b)
        partitions = max(shuffle_partitions(spark), -(-n_docs // task_docs))
        hits = staged(search_trees(placed, asked, weights, k, partitions, block_entries), "lexical-hits")
        known = spark.createDataFrame([(number, item_id) for number, item_id, _ in counted], "number long, item_id long")
        found.append(hits.join(F.broadcast(known), "number"))  # a group's rows: as many as group_bytes has 64ths
        for sent in (vocabulary, weights, asked):
            sent.destroy()
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
