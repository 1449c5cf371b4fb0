"""Rarity of hashed elements from a table of counts of fixed size, and sorts by it.

Elements that share a slot share a count, so on a large corpus all slots hold some rare elements: these then differ from
each other by hash alone, but frequent elements still stand out and come last, which is what keeps prefixes selective.
Any order gives the same results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .hashing import from_packed_sorted, from_planes, packed_sorted, planes

BITS = 23
_CHUNK_BITS = 16
#: Rarity class of an element that was counted once.
ONCE = 8
COUNT_COLUMNS = "chunk int, places binary, counts binary"


class Counter:
    """Counts of elements by the leading bits of their hashes."""

    def __init__(self):
        self.total = np.zeros(1 << BITS, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.total, (hashes >> np.uint64(64 - BITS)).astype(np.int64), 1)

    def rows(self) -> pd.DataFrame:
        rows = []
        for chunk, total in enumerate(self.total.reshape(-1, 1 << _CHUNK_BITS)):
            used = np.flatnonzero(total)
            if len(used):
                rows.append((chunk, packed_sorted(used.astype(np.uint64)), planes(total[used])))
        return pd.DataFrame(rows, columns=["chunk", "places", "counts"])


def rarity_table(counts: DataFrame) -> np.ndarray:
    """Rarity class (8 times the logarithm of the count, at most 255) by leading bits, from rows of counters."""

    def add(_: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << _CHUNK_BITS, np.int64)
        for places, held in zip(chunk["places"], chunk["counts"], strict=True):
            total[from_packed_sorted(places).astype(np.int64)] += from_planes(held).view(np.int64)
        classes = np.minimum(255, np.floor(8 * np.log2(1 + total))).astype(np.uint8)
        return pd.DataFrame({"chunk": [int(chunk["chunk"].iloc[0])], "classes": [classes.tobytes()]})

    table = np.zeros((1 << (BITS - _CHUNK_BITS), 1 << _CHUNK_BITS), np.uint8)
    for row in counts.groupBy("chunk").applyInPandas(add, "chunk int, classes binary").collect():  # 8 MB at any scale
        table[row["chunk"]] = np.frombuffer(row["classes"], np.uint8)
    return table.reshape(-1)


def classes_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[(hashes >> np.uint64(64 - BITS)).astype(np.int64)]


def grouped_order(group: np.ndarray, value: np.ndarray, middle: np.ndarray | None = None) -> np.ndarray:
    """Order by group, (middle, below 256,) and value: one sort by leading bits, a full one only where these tie."""
    bits = 64 - int(group.max(initial=0)).bit_length()
    key = group.astype(np.uint64) << np.uint64(bits % 64) if bits < 64 else np.zeros(len(group), np.uint64)
    if middle is not None:
        bits -= 8
        key |= middle.astype(np.uint64) << np.uint64(bits)
    key |= value >> np.uint64(64 - bits)
    order = np.argsort(key)
    tied = key[order[1:]] == key[order[:-1]]
    if (value[order[1:]][tied] != value[order[:-1]][tied]).any():
        return np.lexsort((value, group) if middle is None else (value, middle, group))
    return order
