"""Best-fit packing of token sequences in bulk-synchronous rounds of Spark jobs.

Texts become token ids and are cut into pieces of at most `capacity`. A round puts the pieces left and the gaps of open
sequences in one order of size (a piece before a gap of its size) and sweeps it: every gap, from the smallest, takes
the largest pieces that fit and are not taken yet. That is the matching of brackets, a piece opening and a gap
closing one, so prefix sums of the order give every row its level, and the next gap on a piece's level is the one that
takes it. Levels are dealt by hash; sizes are whole numbers up to `capacity`, so no level holds more than twice as many
rows, whatever the input. A gap closes as many brackets as copies of its largest fitting piece fit, so what it takes
never exceeds it. Gaps shrink by what they took and the next round follows; where no piece fits any gap, the largest
pieces open new sequences, no more than the words left need. Rows of one size take places by rank: pieces are ranked
once, gaps in each round, by prefix sums over (size, hash bucket), so that no size is one task's work. Each round is
written to the shared folder; what reaches the driver is how many pieces and gaps there are of each size, at most twice
`capacity` numbers, from which it makes the table of levels that is broadcast.

Null or empty text is a piece of the end id alone. Repeated rows are packed as rows of their own. An empty table gives
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, shuffle_partitions, staged, trimmed

_BUCKETS = 64
_PIECE, _GAP = 0, 1
# Sizes, kinds and buckets are ints, so that a pair of them fits one long as a join's key.
_KEYS = ("doc_id", "piece", "start", "ids_crc32")
_BEFORE = (Window.unboundedPreceding, -1)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    ship_package(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .tokens import word_tokenizer

        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], tokenizer.encode([t or "" for t in batch["text"]]), strict=True):
                ids += end
                rows += [
                    (doc_id, k, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step]))
                    for k, at in enumerate(range(0, len(ids), step))
                ]
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _ranked(rows: DataFrame, size: str, *keys: str) -> DataFrame:
    """rows with rank: its place, from 0, among the rows of its size."""
    buckets = max(_BUCKETS, shuffle_partitions(rows.sparkSession))
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(size).orderBy("bucket").rowsBetween(*_BEFORE)
    counts = salted.groupBy(size, "bucket").agg(F.count("*").alias("many"))
    firsts = counts.select(size, "bucket", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("first_rank"))
    inside = Window.partitionBy(size, "bucket").orderBy(*keys)
    # Merged: a broadcast side would be the rows themselves, which grow with the input.
    placed = salted.hint("merge").join(firsts, [size, "bucket"]).withColumn("rank", F.col("first_rank") + F.row_number().over(inside) - 1)
    return placed.drop("bucket", "first_rank")


def _opened(left: DataFrame, sizes: Counter, capacity: int, first: int) -> tuple[DataFrame, int]:
    """left with sequence: that which the piece opens, null if it waits; and the next id. Ids follow each other from `first`.

    Every piece over half a sequence opens one, and the largest of the others until there are as many as all need.
    """
    need = -(-sum(size * many for size, many in sizes.items()) // capacity)
    plan, larger, start = [], 0, first
    for size, many in sorted(sizes.items(), reverse=True):
        opens = many if 2 * size > capacity else max(0, min(many, need - larger))
        plan.append((size, many - opens, start))
        larger, start = larger + many, start + opens
    plan = left.sparkSession.createDataFrame(plan, "length int, stay long, first_sequence long")
    sequence = F.when(F.col("rank") >= F.col("stay"), F.col("first_sequence") + F.col("rank") - F.col("stay"))
    return left.join(F.broadcast(plan), "length").select("length", "rank", sequence.alias("sequence")), start


def _swept(left: DataFrame, gaps: DataFrame, sizes: Counter, holes: Counter) -> DataFrame:
    """left with sequence: that whose gap takes the piece in this round, null if none does."""
    # At most a row a size and kind. Gaps of a size close `times` brackets each, all gaps at most some twice the pieces.
    levels, depth, fits, share = [], 0, 1, max(1, 2 * sizes.total() // holes.total())
    for size, kind in sorted([(size, _PIECE) for size in sizes] + [(size, _GAP) for size in holes]):
        if kind == _PIECE:
            times, fits, step = 1, size, sizes[size]
        else:
            times = min(size // fits, share)
            step = -holes[size] * times
        levels.append((size, kind, times, depth))
        depth += step
    levels = F.broadcast(left.sparkSession.createDataFrame(levels, "size int, kind int, times long, depth long"))
    openings = left.select(F.col("length").alias("size"), F.lit(_PIECE).alias("kind"), "rank", F.lit(None).cast("long").alias("sequence"))
    closings = _ranked(gaps, "gap", "sequence").select(F.col("gap").alias("size"), F.lit(_GAP).alias("kind"), "rank", "sequence")
    level = F.when(F.col("kind") == _PIECE, F.col("depth") + F.col("rank") + 1).otherwise(
        F.col("depth") - F.col("rank") * F.col("times") - F.col("copy")
    )
    brackets = openings.union(closings).join(levels, ["size", "kind"])
    brackets = brackets.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).withColumn("level", level)
    # The rows of a level are pieces and gaps in turn, so the row after a piece is a gap, or there is none.
    after = F.lead("sequence").over(Window.partitionBy("level").orderBy("size", "kind"))
    matched = brackets.withColumn("taker", after).filter(F.col("kind") == _PIECE)
    return matched.select(F.col("size").alias("length"), "rank", F.col("taker").alias("sequence"))


def _sizes(rows: DataFrame, size: str) -> Counter:
    """How many rows there are of each size: at most as many entries as sizes, whatever the input."""
    return Counter(dict(map(tuple, rows.groupBy(size).agg(F.count("*")).collect())))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with sequence_id and offset; the columns doc_id, piece, start, length and ids_crc32 are needed.

    No length may be below 1 or above `capacity`.
    """
    names = pieces.columns
    given = staged(pieces, "pieces").select(F.struct("*").alias("row"), *_KEYS, F.col("length").cast("int").alias("length"))
    ranked = staged(_ranked(given, "length", *_KEYS).select("row", "length", "rank"), "ranked-pieces")
    left, gaps, opened, places = ranked.select("length", "rank"), None, 0, []
    sizes, holes = _sizes(left, "length"), Counter()
    while sizes or not places:
        if holes:
            step = _swept(left, gaps, sizes, holes)
        else:
            step, opened = _opened(left, sizes, capacity, opened)
        step = staged(step, "packing-round")
        placed = step.filter("sequence is not null").withColumn("round", F.lit(len(places)))
        places.append(placed)
        left = step.filter("sequence is null").select("length", "rank")
        sizes = _sizes(left, "length")
        if not sizes:
            break
        if holes:
            taken = placed.select("sequence", -F.col("length"))
            gaps = gaps.union(taken).groupBy("sequence").agg(F.sum("gap").cast("int").alias("gap"))
        else:
            gaps = placed.select("sequence", (F.lit(capacity) - F.col("length")).alias("gap"))
        gaps = staged(gaps.filter(F.col("gap") >= min(sizes)), "packing-gaps")
        holes = _sizes(gaps, "gap")
    inside = Window.partitionBy("sequence").orderBy("round", F.desc("length"), "rank").rowsBetween(*_BEFORE)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0))
    found = reduce(DataFrame.union, places).select("length", "rank", F.col("sequence").alias("sequence_id"), offset.alias("offset"))
    return ranked.hint("merge").join(found, ["length", "rank"]).select(*[F.col(f"row.`{c}`").alias(c) for c in names], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
