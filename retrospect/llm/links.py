"""Connected components of links, and the cells in which linked items are compared exactly.

Both similarity joins find candidate links first, take the components of those links, and compare the items of a
component with each other. A component of more than `cell_items` items is split into blocks, and each pair of blocks
is one cell, so a group of any size is spread over tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, trimmed
from .hashing import from_planes, planes

#: Set sizes up to which parity bitmaps have 1, 2, 4, 8, 16 and 32 words (else 64).
_BITMAP_SIZES = np.array([64, 160, 400, 1000, 2000, 4000])


#: Most sets under one element that are paired in one place; more are dealt to pieces.
HOT_SETS = 16_384
_SIZE_BITS = np.uint64((1 << 20) - 1)


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """How many elements, first in one common order, two sets of which one has this size must share one of."""
    return size - (percent * size + 99) // 100 + 1


def index_length(size: np.ndarray, percent: int) -> np.ndarray:
    """As prefix_length, where the other set is as large or larger: a shared element lies among so many of the smaller one's."""
    return size + (-2 * percent * size) // (100 + percent) + 1


def bitmap_words(size: np.ndarray) -> np.ndarray:
    return 1 << np.searchsorted(_BITMAP_SIZES, size)


def parity_bitmaps(owner: np.ndarray, element: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each set's bitmap, and the bitmaps one after the other: bits that an odd number of elements hit."""
    many = bitmap_words(size)
    first = np.concatenate([[0], np.cumsum(many)])
    place = element & (64 * many - 1).astype(np.uint64)[owner]
    at = (first[owner] << 6) + place.astype(np.int64)
    hits = np.bincount(at, minlength=64 * first[-1]).astype(np.uint8) & np.uint8(1)
    return first, np.packbits(hits, bitorder="little").view("<u8")


def ragged(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Positions first .. first + many - 1 of each entry, one after the other."""
    total = np.cumsum(many)
    return np.repeat(first - (total - many), many) + np.arange(total[-1] if len(total) else 0)


class Bitmaps:
    """Parity bitmaps of postings, each at its own length; a longer one folds to a shorter one by exclusive or."""

    def __init__(self, size: np.ndarray, held: np.ndarray):
        self.many, self.held = bitmap_words(size), held
        self.first = np.cumsum(self.many) - self.many

    def _at_length(self, rows: np.ndarray, length: int) -> np.ndarray:
        many = self.many[rows]
        out = np.empty((len(rows), length), np.uint64)
        for own in np.unique(many).tolist():
            here = many == own
            found = self.held[self.first[rows[here]][:, None] + np.arange(own)]
            while found.shape[1] > length:
                found = found[:, : found.shape[1] // 2] ^ found[:, found.shape[1] // 2 :]
            out[here] = found
        return out

    def distances(self, i: np.ndarray, j: np.ndarray, lot: int = 8192) -> np.ndarray:
        """Hamming distances of pairs of rows, at the shorter length of the two, a bounded number of pairs at a time."""
        out = np.zeros(len(i), np.int64)
        length = np.minimum(self.many[i], self.many[j])
        for words in np.unique(length).tolist():
            pairs = np.flatnonzero(length == words)
            for start in range(0, len(pairs), lot):
                k = pairs[start : start + lot]
                out[k] = np.bitwise_count(self._at_length(i[k], words) ^ self._at_length(j[k], words)).sum(axis=1)
        return out


class Postings:
    """Prefix elements of sets in the order of (element, size, set), each once: element, set's name, size, place, bitmap row."""

    def __init__(self, element: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int):
        # Elements to 44 bits: a clash makes pairs that the filters or the verification drop.
        key = (element & ~_SIZE_BITS) | np.minimum(size, int(_SIZE_BITS)).astype(np.uint64)
        order = np.argsort(key) if size.max(initial=0) < _SIZE_BITS else np.lexsort((size, key))
        self._take(order, key[order], name, size, place)
        # Alone under its element, or with no set of like size there: can't be in a pair.
        near = np.zeros(len(order), bool)
        pair = (self.group[1:] == self.group[:-1]) & (100 * self.size[:-1] >= percent * self.size[1:])
        near[1:] |= pair
        near[:-1] |= pair
        order = order[near]
        order = order[np.lexsort((name[order], size[order], key[order]))]
        self._take(order, key[order], name, size, place)
        new = np.ones(len(order), bool)
        new[1:] = (self.group[1:] != self.group[:-1]) | (self.name[1:] != self.name[:-1])
        order = order[new]
        self._take(order, key[order], name, size, place)

    def _take(self, order: np.ndarray, key: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray) -> None:
        self.row, self.group = order, key | _SIZE_BITS
        self.name, self.size, self.place = name[order], size[order], place[order]

    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]])) if len(self.group) else np.zeros(0, np.int64)


def connecting_pairs(
    group: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, side: np.ndarray | None, row: np.ndarray, bitmaps: Bitmaps, percent: int
) -> list[tuple[int, int]]:
    """Links among sets that may be alike, from postings in the order of (group, size).

    Pairs of one group (and of two sides, if given) pass the length filter, the index filter (the smaller set's element
    lies in its shorter prefix), the positional filter and the parity filter (the Hamming distance of two bitmaps is at
    most the sets' difference). Pairs are enumerated by distance in the order of size; those already connected are
    passed over, so the links are at most as many as the sets.
    """
    names, item = np.unique(name, return_inverse=True)
    up = np.arange(len(names))
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    active, step = np.flatnonzero(place < index_length(size, percent)), 1
    while len(active):
        active = active[active + step < len(group)]
        other = active + step
        active = active[(group[active] == group[other]) & (100 * size[active] >= percent * size[other])]
        i, j = active, active + step
        if side is not None:
            across = side[i] != side[j]
            i, j = i[across], j[across]
        least = -(-percent * (size[i] + size[j]) // (100 + percent))
        fits = (np.minimum(size[i] - place[i], size[j] - place[j]) >= least) & (up[item[i]] != up[item[j]])
        i, j = i[fits], j[fits]
        most = (100 - percent) * (size[i] + size[j]) // (100 + percent)
        close = bitmaps.distances(row[i], row[j]) <= most
        if close.any():
            for a, b in zip(item[i[close]].tolist(), item[j[close]].tolist(), strict=True):
                ra, rb = root(a), root(b)
                if ra != rb:
                    up[max(ra, rb)] = min(ra, rb)
                    links.append((int(names[a]), int(names[b])))
            while (up[up] != up).any():
                up[:] = up[up]
        step += 1
        if step % 16 == 0 and len(active):  # elements whose sets are all connected need no more pairs
            label = up[item]
            open_ = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
            active = active[open_[np.searchsorted(start, active, side="right") - 1]]
    return links


#: What a bucket gives: links (a, b), or pieces: two stretches of the sets under one element that are still to be paired.
FOUND = "a long, b long, names binary, sizes binary, places binary, sides binary, bitmaps binary"
_FOUND_NAMES = [column.split()[0] for column in FOUND.split(", ")]


def _piece(p: Postings, one: slice, other: slice, bitmaps: Bitmaps) -> tuple:
    """Two stretches (or one) of the sets under one element, in the order of size."""
    rows = np.arange(one.start, one.stop)
    side = np.zeros(len(rows), np.int64)
    if one != other:
        rows = np.concatenate([rows, np.arange(other.start, other.stop)])
        side = np.concatenate([side, np.ones(len(rows) - len(side), np.int64)])
        order = np.argsort(p.size[rows], kind="stable")
        rows, side = rows[order], side[order]
    own = p.row[rows]
    held = bitmaps.held[ragged(bitmaps.first[own], bitmaps.many[own])]
    return (None, None, planes(p.name[rows]), planes(p.size[rows]), planes(p.place[rows]), planes(side), held.tobytes())


def links_of_bucket(
    element: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, held: np.ndarray, percent: int, hot_sets: int = HOT_SETS
) -> pd.DataFrame:
    """Links among the postings of a bucket; an element with more than hot_sets sets is left to pieces of that size."""
    bitmaps, p = Bitmaps(size, held), Postings(element, name, size, place, percent)
    start = p.starts()
    many = np.diff(start, append=len(p.group))
    kept = np.repeat(many <= hot_sets, many)
    found = [
        (a, b, None, None, None, None, None)
        for a, b in connecting_pairs(p.group[kept], p.name[kept], p.size[kept], p.place[kept], None, p.row[kept], bitmaps, percent)
    ]
    for first, n in zip(start[many > hot_sets].tolist(), many[many > hot_sets].tolist(), strict=True):
        cuts = [slice(at, min(at + hot_sets, first + n)) for at in range(first, first + n, hot_sets)]
        for k, one in enumerate(cuts):
            for other in cuts[k:]:
                if 100 * p.size[one.stop - 1] >= percent * p.size[other.start]:
                    found.append(_piece(p, one, other, bitmaps))
    return pd.DataFrame(found, columns=_FOUND_NAMES).astype({"a": "Int64", "b": "Int64"})


def all_links(found: DataFrame, percent: int) -> DataFrame:
    """a, b from the rows of links_of_bucket: those there are, and those of the pieces, each piece by itself."""

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for names, sizes, places, sides, held in batch[_FOUND_NAMES[2:]].itertuples(index=False):
                name, size, place, side = (from_planes(x).view(np.int64) for x in (names, sizes, places, sides))
                bitmaps = Bitmaps(size, np.frombuffer(held, np.uint64))
                group = np.zeros(len(name), np.uint64)
                links = connecting_pairs(group, name, size, place, side if side.any() else None, np.arange(len(name)), bitmaps, percent)
                yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    # One row a piece: dealt by content, so that the pieces of one element go to many tasks.
    pieces = found.filter("a is null").repartition("names", "sides").mapInPandas(trimmed(pair), "a long, b long")
    return found.filter("a is not null").select("a", "b").unionByName(pieces)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step of the alternating algorithm: neighbours move to the smallest node they see."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node on an edge (a, b of type long).

    Large-star and small-star steps in turn until the links no longer change; each round is written to the shared
    folder. What the driver sees is three numbers a round.
    """
    mark = None
    current = staged(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    while True:
        current = staged(_star(_star(current, True), False), "links")
        seen = current.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if seen == mark:
            break
        mark = seen
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


CELL = ["root", "side_a", "side_b"]


def cells(members: DataFrame, sizes: DataFrame, cell_items: int) -> DataFrame:
    """members (root, item, ...) once for every cell (root, side_a, side_b) that compares them, with block.

    sizes: root, items. A small component is one cell (0, 0); a large one has a cell for each pair of blocks. Cells are
    gathered to lots of a few of them, so that a task sees fewer and even groups.
    """
    shown = sizes.agg(F.coalesce(F.sum(F.col("items") * F.ceil(F.col("items") / F.lit(cell_items))), F.lit(0))).first()[0]
    lots = max(1, -(-int(shown) // cell_items))
    blocks = F.ceil(F.col("items") / F.lit(cell_items)).cast("int")
    dealt = members.join(sizes, "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    return (
        dealt.withColumn("other", F.explode(others))
        .withColumn("side_a", F.least("block", "other"))
        .withColumn("side_b", F.greatest("block", "other"))
        .withColumn("lot", F.pmod(F.xxhash64(*CELL), F.lit(lots)))
        .drop("items", "blocks", "other")
    )
