"""Exact top-k by integer inner product over a bit-sliced index.

Components are quantised to integers. The index holds blocks of rows; in a block every component is shifted to start
at 0 and stored as bit slices: bitmap b of a component has a bit for each row whose value has bit b set. For a query,
the slices of component d go to the columns of weight 2^(j+b) for every set bit j of the query's component; a negative
query component uses the complements, its constant is the same for the whole block. Carry-save adders reduce the columns to one
bitmap a bit of the score. From the most significant slice down, rows are kept as surely in, still equal, or out, until
k are in; what is still equal at the end ties exactly and is taken in order of id. Every block gives at most k rows to
a query, and a final ranking over the blocks gives the answer.

The query set meets all rows in cells of one index block and one query block; the work per row is bitmap arithmetic.
Vectors that are null or hold null or non-finite components take no part. Where the quantised squared lengths of a
block's rows and of the query are below 2^62, no score passes 63 bits by Cauchy and Schwarz; longer vectors are wide: they
lie in blocks of their own, of fewer rows, and numbers of any length take the place of 64-bit ones, so that scores stay
exact. A score among a block's best that no long can hold ends the query with an error, rather than being left out.
Shorter vectors count as padded with zeros, an empty one has score 0 with all; rows that repeat an id are rows of their own, and all rows with the query's id are left out;
ids that are null take no part. An empty table, or one without queries, gives no rows. `queries` may use vec_id and vec;
other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, staged


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, vec (array of whole doubles) and wide (too long for 64-bit scores) of the rows that take part."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    scaled = lambda v: v.cast("double") * F.lit(float(scale))
    # Beyond 2^53 a double is whole, and floor would make it a long.
    whole = lambda v: F.when(F.abs(v) < F.lit(2.0**53), F.floor(v).cast("double")).otherwise(v)
    squared = F.aggregate("vec", F.lit(0.0), lambda total, v: total + v * v)
    kept = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, finite))
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: whole(scaled(v))).alias("vec"))
    return rows.withColumn("wide", squared >= F.lit(2.0**61))  # half of the bound, as the sum is rounded


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _whole(values: np.ndarray, wide: bool) -> np.ndarray:
    """Whole doubles as 64-bit numbers, or as numbers of any length."""
    return np.frompyfunc(int, 1, 1)(values).astype(object) if wide else values.astype(np.int64)


def _bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, short)])).view(np.uint64)


def build_block(block: pd.DataFrame) -> pd.DataFrame:
    """One index row: ids in order, values (whole doubles), bit slices [component, bit, word]."""
    block = block.sort_values("vec_id", kind="stable")
    values = _matrix(block["vec"])
    wide = bool(block["wide"].iloc[0])
    whole = _whole(values, wide)
    raised = (whole - whole.min(axis=0)).T
    bits = max(1, int(raised.max(initial=0)).bit_length())
    slices = np.stack([_bitmaps(((raised >> b) & 1).astype(np.uint8)) for b in range(bits)], axis=1)
    return pd.DataFrame(
        {
            "block": [block["block"].iloc[0]],
            "n_rows": [len(block)],
            "dims": [values.shape[1]],
            "bits": [bits],
            "wide": [wide],
            "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
            "values": [values.tobytes()],
            "slices": [slices.tobytes()],
        }
    )


def score_slices(slices: np.ndarray, query: list[int]) -> list[np.ndarray]:
    """Bitmaps of the score's bits, least first, up to the block's constant."""
    columns: dict[int, list[np.ndarray]] = {}
    for component, q in zip(slices, query, strict=True):
        if q:
            planes = component if q > 0 else ~component
            size = abs(q)
            for j in range(size.bit_length()):
                if size >> j & 1:
                    for b, plane in enumerate(planes):
                        columns.setdefault(j + b, []).append(plane)
    out, weight = [], 0
    top = max(columns, default=-1)
    while weight <= top:
        own = columns.pop(weight, [])
        stack = np.stack(own) if own else np.zeros((1, slices.shape[-1]), np.uint64)
        carries = []
        while len(stack) > 1:
            whole = len(stack) // 3 * 3
            if whole:
                a, b, c = stack[0:whole:3], stack[1:whole:3], stack[2:whole:3]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[whole:]])
            else:
                carries.append((stack[:1] & stack[1:2]))
                stack = stack[:1] ^ stack[1:2]
        if carries:
            columns.setdefault(weight + 1, []).extend(np.concatenate(carries))
            top = max(top, weight + 1)
        out.append(stack[0])
        weight += 1
    return out


def best_rows(bits: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best allowed rows, ties to earlier positions."""
    inside, equal = np.zeros_like(allowed), allowed.copy()
    count = lambda bitmap: int(np.bitwise_count(bitmap).sum())
    for plane in reversed(bits):
        ahead = equal & plane
        found = inside | ahead
        n = count(found)
        if n > k:
            equal = ahead
        else:
            inside, equal = found, equal & ~plane
            if n == k:
                equal = np.zeros_like(equal)
                break
    rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    sure = rows(inside)
    return np.concatenate([sure, rows(equal)[: max(0, k - len(sure))]])


def search_cell(cell: pd.Series, k: int) -> Iterator[tuple[int, int, int]]:
    """query_id, vec_id, score of every query's best rows in one cell of an index block and a query block."""
    n, dims, bits = cell["n_rows"], cell["dims"], cell["bits"]
    ids = np.frombuffer(cell["ids"], np.int64)
    values = np.frombuffer(cell["values"]).reshape(n, dims)
    slices = np.frombuffer(cell["slices"], np.uint64).reshape(dims, bits, -1)
    present = _bitmaps(np.ones((1, n), np.uint8))[0]
    for query in cell["queries"]:
        vec = np.zeros(dims)
        given = np.asarray(query["vec"], float)[:dims]
        vec[: len(given)] = given
        wide = bool(cell["wide"] or query["wide"])
        vec = _whole(vec, wide)
        own = slice(*np.searchsorted(ids, [query["vec_id"], query["vec_id"] + 1]))
        allowed = present
        if own.stop > own.start:
            mask = np.ones((1, n), np.uint8)
            mask[0, own] = 0
            allowed = _bitmaps(mask)[0]
        rows = best_rows(score_slices(slices, vec.tolist()), allowed, k)
        for vec_id, score in zip(ids[rows].tolist(), (_whole(values[rows], wide) @ vec).tolist(), strict=True):
            if not -(1 << 63) <= score < 1 << 63:
                raise OverflowError(f"the score of {query['vec_id']} and {vec_id} does not fit 64 bits")
            yield query["vec_id"], vec_id, score


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, block_rows: int = 32_768, query_rows: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row of vectors that `queries` selects."""
    ship_package(vectors.sparkSession)
    rows = staged(quantised(vectors, scale).withColumn("is_query", queries), "vectors")
    n, n_wide, n_queries = rows.agg(F.count_if(~F.col("wide")), F.count_if("wide"), F.count_if("is_query")).first()
    wide_rows = max(1, block_rows // 64)  # their slices are many
    blocks, wide_blocks, query_blocks = (max(1, -(-m // size)) for m, size in ((n, block_rows), (n_wide, wide_rows), (n_queries, query_rows)))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(parts)).cast("int")
    index = staged(
        rows.withColumn("block", F.when(F.col("wide"), -1 - deal(wide_blocks)).otherwise(deal(blocks)))
        .groupBy("block")
        .applyInPandas(
            build_block,
            "block int, n_rows int, dims int, bits int, wide boolean, ids binary, values binary, slices binary",
        ),
        "bit-sliced-index",
    )
    asked = (
        rows.filter("is_query")
        .withColumn("query_block", deal(query_blocks))
        .groupBy("query_block")
        .agg(F.collect_list(F.struct("vec_id", "vec", "wide")).alias("queries"))
    )
    cells = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).join(asked, "query_block")

    def search(_: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        found = [hit for _, one in cell.iterrows() for hit in search_cell(one, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = cells.groupBy("block", "query_block").applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
