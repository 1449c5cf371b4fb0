"""Hashes of words and word windows of many texts at once, and compact arrays of them for shuffles."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

#: Odd multipliers of the polynomial, length and mixing steps of 64-bit hashes.
_WORD_BASE = 0xD6E8FEB86659FD93
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bytes of white space as 0, all others as 1.
_INSIDE = bytes(0 if b in (9, 10, 11, 12, 13, 32) else 1 for b in range(256))
#: Keeps the first n of 8 bytes.
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_LONG_WORD = 256


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below size."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _sized_powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, 1 << max(16, (size - 1).bit_length()))
    return up[:size], down[:size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


def counted(sorted_at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each of sorted places the number of the stretch that it lies in; stretches begin at starts (sorted, first 0)."""
    cuts = np.searchsorted(sorted_at, starts)
    return np.repeat(np.arange(len(starts)), np.diff(cuts, append=len(sorted_at)))


class Words:
    """Words of a list of texts (UTF-8 bytes): text index, first and last byte in `data`, and hash of each."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.first = first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        inside = np.frombuffer(b"\0" + self.data.translate(_INSIDE) + b"\0", dtype=np.uint8)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.text = counted(self.start, first) if len(texts) else np.zeros(0, np.int64)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Eight bytes of every word at a time; a long word in one step of its own."""
        size = self.end - self.start
        eights = np.ndarray(len(self.data) + 1, "<u8", self.data + bytes(8), 0, (1,))
        h = mixed((eights[self.start] & _FIRST_BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _STEP))
        at, rest = 8, np.flatnonzero((size > 8) & (size <= _LONG_WORD))
        while len(rest):
            part = eights[self.start[rest] + at] & _FIRST_BYTES[np.minimum(size[rest] - at, 8)]
            h[rest] = mixed(h[rest] * _STEP + part)
            at += 8
            rest = rest[size[rest] > at]
        for i in np.flatnonzero(size > _LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest()
            h[i] = np.uint64(int.from_bytes(digest, "little"))
        return h

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word (index) and hash of every window of n words within one text."""
        count = len(self.hash)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _sized_powers(_WORD_BASE, count + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hash * up[:-1], dtype=np.uint64)])
        at = np.flatnonzero(self.text[: count - n + 1] == self.text[n - 1 :])
        return at, mixed((sums[at + n] - sums[at]) * down[at])


def planes(values: np.ndarray) -> bytes:
    """64-bit values with bytes of like weight together, so that block compression finds the empty ones."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as planes of differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def from_packed_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def chunks_by_bytes(texts: list[bytes] | list[str], limit: int = 1 << 19):
    """Slices of texts of about `limit` bytes (characters of str) each: what is held for a chunk is a few dozen times that."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= limit:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
