"""Hard negatives by Kronecker-packed products.

Candidates lie in blocks. In a block the quantised components of one dimension are raised by a bias to be 0 or more and
written into separated fields of one wide integer, a field a candidate. An anchor multiplies each of these integers
once, by its own component, and adds the products: every field then holds one candidate's inner product, as a field is
wide enough for the largest sum of absolute products and a sign. Unpacking takes the fields apart and the bias off, so
scores are exact at any magnitude.

Blocks are made where their rows are read and written once; anchors come to them in groups of bounded size
(`query_groups`), and a task keeps the best rows of each anchor over all its blocks, so only these are shuffled. A first
pass finds the positives; with their scores known, a second one finds for each (anchor, positive) the first rows of
another label whose score lies between the two shares of the positive's score. No label is one task's work.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Shorter vectors count as
padded with zeros. Rows that repeat an id are rows of their own, but no positive of an anchor with this id; equal rows
are one anchor, an id with different labels or vectors is an anchor each. Ties go to the smaller id. A score that no
long can hold ends the query with an error, rather than being left out. Tables without rows or anchors give no rows.
Other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, staged
from .query_groups import query_groups

_EXACT = 2.0**53
_BLOCK = "n_rows long, width int, bias binary, ids binary, labels binary, fields array<binary>"
_POSITIVE = "number long, anchor_id long, vec_id long, score long"
_NEGATIVE = "number long, anchor_id long, place int, positive_id long, positive_score long, vec_id long, score long"


def quantised(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label and vec (array of whole doubles) of the rows that take part."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    scaled = lambda v: v.cast("double") * F.lit(float(scale))
    # Beyond 2^53 a double is whole, and floor would make it a long.
    whole = lambda v: F.when(F.abs(v) < _EXACT, F.floor(v).cast("double")).otherwise(v)
    kept = vectors.filter(F.col("vec_id").isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, finite))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, lambda v: whole(scaled(v))).alias("vec"))


class PackedBlock:
    """Candidates as wide integers. `largest` bounds the absolute components of all anchors."""

    def __init__(self, vectors: list[np.ndarray], largest: int):
        self.n_rows = len(vectors)
        columns = np.zeros((max(map(len, vectors), default=0), self.n_rows))
        for row, vector in enumerate(vectors):
            columns[: len(vector), row] = vector
        low, high = int(columns.min(initial=0)), int(columns.max(initial=0))
        self.bias = -low
        # Sums of absolute products with raised components stay below half of a field.
        bits = (len(columns) * largest * (high - low)).bit_length() + 2
        self.width = 4 if bits <= 32 else 8 * -(-bits // 64)
        self.fields = [self._packed(column) for column in columns]

    def _packed(self, column: np.ndarray) -> bytes:
        if self.width <= 8 and self.bias < _EXACT:
            return (column.astype(np.int64) + self.bias).astype(f"<u{self.width}").tobytes()
        return b"".join((int(v) + self.bias).to_bytes(self.width, "little") for v in column)


class BlockScorer:
    """score(anchor) gives the exact inner products with all candidates of a packed block."""

    def __init__(self, n_rows: int, width: int, bias: int, fields: list[bytes]):
        self.n_rows, self.width, self.bias = n_rows, width, bias
        self.wide = [int.from_bytes(f, "little") for f in fields]
        self.half = 1 << (8 * width - 1)
        self.halves = int.from_bytes(self.half.to_bytes(width, "little") * n_rows, "little")

    def score(self, anchor: list[int]) -> np.ndarray:
        total = self.halves  # half a field more each, so that no field is negative and borrows from its neighbour
        for a, wide in zip(anchor, self.wide, strict=False):
            if a:
                total += a * wide
        raised = self.half + self.bias * sum(anchor[: len(self.wide)])
        packed = total.to_bytes(self.n_rows * self.width, "little")
        if self.width == 4:
            return np.frombuffer(packed, "<u4").astype(np.int64) - raised
        steps = range(0, len(packed), self.width)
        scores = [int.from_bytes(packed[at : at + self.width], "little") - raised for at in steps]
        return np.array(scores, dtype=np.int64 if self.width == 8 else object)


def first_rows(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of the positions `rows` the first k by falling score and rising id."""
    if len(rows) > k and scores.dtype != object:
        own = scores[rows]
        rows = rows[own >= np.partition(own, -k)[-k]]
    order = sorted(rows.tolist(), key=lambda i: (-int(scores[i]), int(ids[i])))[:k]
    return np.array(order, dtype=np.int64)


def _long(score: int, anchor_id: int, vec_id: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"the score of the anchor {anchor_id} and the row {vec_id} does not fit 64 bits")
    return score


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """Of (score, id) the first k."""
    return sorted(found, key=lambda pair: (-pair[0], pair[1]))[:k]


def pack_blocks(rows: DataFrame, largest: int, block_rows: int) -> DataFrame:
    """Blocks of at most block_rows candidates, of the rows as they are read."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(frame: pd.DataFrame) -> pd.DataFrame:
            block = PackedBlock(list(frame["vec"]), largest)
            bias = block.bias.to_bytes(block.bias.bit_length() // 8 + 1, "little")
            ids, labels = (frame[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
            return pd.DataFrame({"n_rows": [len(frame)], "width": [block.width], "bias": [bias], "ids": [ids], "labels": [labels], "fields": [block.fields]})

        waiting: list[pd.DataFrame] = []
        for batch in batches:
            waiting.append(batch)
            while sum(map(len, waiting)) >= block_rows:
                joined = pd.concat(waiting)
                yield packed(joined.iloc[:block_rows])
                waiting = [joined.iloc[block_rows:]]
        if sum(map(len, waiting)):
            yield packed(pd.concat(waiting))

    return rows.mapInPandas(pack, _BLOCK)


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[BlockScorer, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            scorer = BlockScorer(int(row.n_rows), int(row.width), int.from_bytes(row.bias, "little"), list(row.fields))
            yield scorer, np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)


def _positives(blocks: DataFrame, anchors, k: int) -> DataFrame:
    """The best rows of the anchor's own label, of every task."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[int, int]]] = {}
        for scorer, ids, labels in _scored(batches):
            for a in anchors.value:
                rows = np.flatnonzero((labels == a["label"]) & (ids != a["vec_id"]))
                if len(rows):
                    scores = scorer.score(a["vec"])
                    found = [(int(scores[i]), int(ids[i])) for i in first_rows(scores, ids, rows, k)]
                    best[a["number"]] = _best(best.get(a["number"], []) + found, k)
        known = {a["number"]: a["vec_id"] for a in anchors.value}
        out = [(n, known[n], vec_id, _long(score, known[n], vec_id)) for n, pairs in best.items() for score, vec_id in pairs]
        yield pd.DataFrame(out, columns=["number", "anchor_id", "vec_id", "score"]).astype("int64")

    return blocks.mapInPandas(search, _POSITIVE)


def _negatives(blocks: DataFrame, anchors, positives, k: int, low: int, high: int) -> DataFrame:
    """The best rows of other labels within the shares of each positive's score, of every task."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for scorer, ids, labels in _scored(batches):
            for a in anchors.value:
                bounds = [(place, -(-low * p // 100), high * p // 100) for place, (_, p) in enumerate(positives.value.get(a["number"], ()))]
                bounds = [b for b in bounds if b[1] <= b[2]]
                others = labels != a["label"]
                if not bounds or not others.any():
                    continue
                scores = scorer.score(a["vec"])
                for place, least, most in bounds:
                    rows = np.flatnonzero(others & (scores >= least) & (scores <= most))
                    if len(rows):
                        found = [(int(scores[i]), int(ids[i])) for i in first_rows(scores, ids, rows, k)]
                        best[a["number"], place] = _best(best.get((a["number"], place), []) + found, k)
        known = {a["number"]: a["vec_id"] for a in anchors.value}
        out = [(n, known[n], place, *positives.value[n][place], vec_id, score) for (n, place), pairs in best.items() for score, vec_id in pairs]
        yield pd.DataFrame(out, columns=["number", "anchor_id", "place", "positive_id", "positive_score", "vec_id", "score"]).astype("int64")

    return blocks.mapInPandas(search, _NEGATIVE)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 4096, group_bytes: int = 8 << 20
) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, label and vec, as `quantised` makes them; `is_anchor` selects the anchors. A negative's score is
    between `low` and `high` hundredths of the positive's.
    """
    spark = rows.sparkSession
    ship_package(spark)
    anchors = staged(rows.filter(is_anchor).distinct(), "anchors")
    largest = anchors.agg(F.max(F.array_max(F.transform("vec", lambda v: F.abs(v))))).first()[0]
    blocks = staged(pack_blocks(rows, max(1, int(largest or 0)), block_rows), "packed-blocks")
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    found = []
    for group in query_groups(anchors, F.lit(64) + 32 * F.size("vec"), group_bytes):
        asked = spark.sparkContext.broadcast([{"number": a.number, "vec_id": a.vec_id, "label": a.label, "vec": [int(v) for v in a.vec]} for a in group])
        best = _positives(blocks, asked, positives).withColumn("rank", rank("number")).filter(F.col("rank") <= positives)
        of_anchor: dict[int, list[tuple[int, int]]] = {}
        for row in best.orderBy("number", "rank").collect():  # at most `positives` a row of the group
            of_anchor.setdefault(row.number, []).append((row.vec_id, row.score))
        known = spark.sparkContext.broadcast(of_anchor)
        found.append(staged(_negatives(blocks, asked, known, negatives, low, high), "hard-negatives"))
        asked.destroy()
        known.destroy()
    if not found:
        found.append(spark.createDataFrame([], _NEGATIVE))
    ranked = reduce(DataFrame.union, found).withColumn("rank", rank("number", "place")).filter(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).alias("positive_rank"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
