"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder as a state machine over bytes.

A text runs through two transducers. The first cuts it into pre-tokens (contractions, runs of letters, of numbers, of
other signs, of white space); it holds back the two characters that its pattern may still look at. The second turns a
pre-token's bytes into tokens. Its lookahead is computed from the merge list: where two texts agree up to a byte, the
first merge of only one of them that crosses this byte, of the pair (u, v), takes at most the bytes of u before it; a
later merge of only one of them can go further left only where its right side starts with such a u. So with

    reach(u, v) = bytes of u + the largest reach of an earlier merge whose left side starts v (0, if there is none)

no token that ends the largest reach before the end of what has been read depends on what follows: it is stable. A
pre-token of any length is read in windows; stable tokens are given out, the next window starts behind them. The
encoder holds one window, a cache of short pre-tokens with a bound and, of a row, the ids made so far.

The decoder keeps the bytes of an unfinished character between ids and gives out text once characters are complete.

Null and empty texts have no ids and decode to an empty text; ids that the vocabulary lacks have no bytes, bytes that
are no UTF-8 become U+FFFD; repeated rows and rows with a null id are coded each; texts of any length are coded whole;
an empty table gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .tokens import BYTE_LETTERS

#: White space of the pattern, and the letters and numbers that Unicode 16 has beyond version 15.1.
_SPACES = "\t-\r \x85\xa0  -     　"
_NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

_LETTERS = [BYTE_LETTERS.get(b, chr(b)) for b in range(256)]

_HELD_BACK = 2
_SHORT = 64
_WORDS_AT_ONCE = 512
_CACHE_ENTRIES = 1_000_000
_BASIC, _ALL = 0x10000, 0x110000

_encoders: dict[tuple[str, int], StreamingEncoder] = {}
_tables: dict[str, list[bytes]] = {}


class PreTokenPattern:
    """Regular expressions for texts below a code point: the whole pattern, and the rest of a run by a character of it."""

    def __init__(self, limit: int):
        letters, numbers = self._of("L", _NEWER_LETTERS, limit), self._of("N", _NEWER_NUMBERS, limit)
        self.whole = re.compile(
            rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{_SPACES}{letters}{numbers}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
        )
        kinds = (f"[{letters}]", f"[{numbers}]", f"[{_SPACES}]", f"[^{_SPACES}{letters}{numbers}]")
        self.runs = [(re.compile(kind), re.compile(f"{kind}*"), kind == kinds[2]) for kind in kinds]

    @staticmethod
    def _of(category: str, newer: tuple[tuple[int, int], ...], limit: int) -> str:
        ranges: list[list[int]] = []
        points = {c for c in range(limit) if unicodedata.category(chr(c))[0] == category}
        points.update(c for first, last in newer for c in range(first, last + 1) if c < limit)
        for c in sorted(points):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)

    def run_of(self, char: str) -> tuple[re.Pattern, bool]:
        return next((run, spaces) for one, run, spaces in self.runs if one.match(char))


_patterns: dict[int, PreTokenPattern] = {}
_BEYOND_BASIC = re.compile("[\U00010000-\U0010ffff]")


def _pattern_for(text: str) -> PreTokenPattern:
    limit = _ALL if _BEYOND_BASIC.search(text) else _BASIC
    if limit not in _patterns:
        _patterns[limit] = PreTokenPattern(limit)
    return _patterns[limit]


class PreTokenStream:
    """feed(chunk) gives pre-tokens, in parts where one is longer than `long`; the flag tells whether the pre-token ends."""

    def __init__(self, long: int = 4096):
        self.long, self.rest, self.in_run, self.spaces = long, "", "", False

    def feed(self, chunk: str, last: bool = False) -> list[tuple[str, bool]]:
        text, out = self.rest + chunk, []
        self.rest = ""
        pattern = _pattern_for(text)
        if self.in_run:
            run, spaces = _pattern_for(text + self.in_run).run_of(self.in_run)
            end = run.match(text).end()
            if end == len(text) and not last:
                cut = max(0, end - _HELD_BACK)
                self.rest = text[cut:]
                return [(text[:cut], False)]
            end -= spaces and end < len(text)  # the last space before a sign is not part of the run
            out.append((text[:end], True))
            text, self.in_run = text[end:], ""
        words = pattern.whole.findall(text)
        if last:
            return out + [(word, True) for word in words]
        held: list[str] = []
        while words and sum(map(len, held)) < _HELD_BACK:
            held.append(words.pop())
        out += [(word, True) for word in words]
        self.rest = "".join(reversed(held))
        if len(held) == 1 and len(self.rest) > self.long:
            self.in_run = self.rest[-1]
            out.append((self.rest[:-_HELD_BACK], False))
            self.rest = self.rest[-_HELD_BACK:]
        return out


def sufficient_lookahead(merges: Iterable[tuple[str, str]]) -> int:
    """Bytes behind a token after which no continuation changes it, from merges in byte spelling, first merge first."""
    reach_by_left: dict[str, int] = {}
    largest = 0
    for left, right in merges:
        reach = len(left) + max((reach_by_left.get(right[:i], 0) for i in range(1, len(right) + 1)), default=0)
        reach_by_left[left] = max(reach, reach_by_left.get(left, 0))
        largest = max(largest, reach)
    return largest


class StreamingEncoder:
    """Ids of texts by a tokenizer file of byte-level BPE, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, window: int = 8192, chunk: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cutter = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.lookahead, self.window, self.chunk = sufficient_lookahead(merges), window, chunk
        self.sizes = np.zeros(1 + max(spec["model"]["vocab"].values()), np.int64)
        for token, number in spec["model"]["vocab"].items():
            self.sizes[number] = len(token)
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", ())):
            raise ValueError("added tokens that strip or match whole words only are not supported")
        self.added = {content: array("I", [number]).tobytes() for content, number in added.items()}
        self.added_pattern = re.compile(f"({'|'.join(re.escape(c) for c in sorted(added, key=len, reverse=True))})") if added else None
        self.merger = Tokenizer(Tokenizer.from_file(path).model)  # merges of one window, or of windows between spaces
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # no byte is spelled as white space
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _spelled(piece: str) -> str:
        return "".join(map(_LETTERS.__getitem__, piece.encode()))

    def _merged(self, window: str) -> list[int]:
        return self.merger.encode(window, add_special_tokens=False).ids

    def _fill_cache(self, words: set[str]) -> None:
        missing = [w for w in words.difference(self.cache) if len(w) <= _SHORT]
        if len(self.cache) + len(missing) > _CACHE_ENTRIES:
            self.cache.clear()
            missing = [w for w in words if len(w) <= _SHORT]
        for at in range(0, len(missing), _WORDS_AT_ONCE):
            lot = missing[at : at + _WORDS_AT_ONCE]
            coded = self.merger.encode(" ".join(map(self._spelled, lot)), add_special_tokens=False)
            ids = array("I", coded.ids).tobytes()
            ends = np.searchsorted(np.asarray(coded.word_ids), np.arange(len(lot)), side="right") * 4
            self.cache.update(zip(lot, map(ids.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))

    def _long(self, pending: str, ends: bool) -> tuple[bytes, str]:
        """Stable ids of the bytes of a long pre-token read so far, and the bytes behind them; all ids where it ends."""
        out: list[bytes] = []
        width = self.window + self.lookahead
        while len(pending) > width:
            ids = self._merged(pending[:width])
            ends_at = self.sizes[ids].cumsum()
            stable = max(1, int(np.searchsorted(ends_at, width - self.lookahead, side="right")))
            out.append(array("I", ids[:stable]).tobytes())
            pending = pending[int(ends_at[stable - 1]) :]
        if ends:
            out.append(array("I", self._merged(pending)).tobytes())
            pending = ""
        return b"".join(out), pending

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Ids as they become stable, of a text without added tokens that comes in chunks."""
        cutter, pending, inside = PreTokenStream(), "", False
        ahead = iter(chunks)
        chunk, following = next(ahead, None), None
        while chunk is not None:
            following = next(ahead, None)
            pieces = cutter.feed(chunk, last=following is None)
            self._fill_cache({piece for piece, _ in pieces})
            out = []
            for piece, ends in pieces:
                if not inside and ends and len(piece) <= _SHORT:
                    out.append(self.cache[piece])
                else:
                    ids, pending = self._long(pending + self._spelled(piece), ends)
                    out.append(ids)
                    inside = not ends
            yield b"".join(out)
            chunk = following

    def _chunks(self, text: str) -> Iterator[str]:
        return (text[at : at + self.chunk] for at in range(0, len(text), self.chunk))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if len(text) <= self.chunk and not (self.added_pattern and self.added_pattern.search(text)):
                plain[i] = _pattern_for(text).whole.findall(text)
        self._fill_cache(set().union(*plain.values()))
        out: list[bytes | None] = []
        for i in range(len(texts)):
            try:
                out.append(b"".join(map(self.cache.__getitem__, plain[i])))
            except KeyError:  # a long pre-token, a long text or one with added tokens
                out.append(None)
        return [self._streamed(text) if ids is None else ids for ids, text in zip(out, texts, strict=True)]

    def _streamed(self, text: str) -> bytes:
        parts = self.added_pattern.split(text) if self.added_pattern else [text]
        return b"".join(self.added[part] if k % 2 else b"".join(self.stream(self._chunks(part))) for k, part in enumerate(parts))


def streaming_encoder(path: str, window: int = 8192) -> StreamingEncoder:
    if (path, window) not in _encoders:
        _encoders[path, window] = StreamingEncoder(path, window)
    return _encoders[path, window]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a tokenizer file; added tokens are their own text."""
    if path not in _tables:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        known = {letter: byte for byte, letter in enumerate(_LETTERS)}
        spelled = {number: bytes(known[c] for c in token) for token, number in spec["model"]["vocab"].items()}
        spelled |= {a["id"]: a["content"].encode() for a in spec.get("added_tokens", ())}
        _tables[path] = [spelled.get(i, b"") for i in range(1 + max(spelled))]
    return _tables[path]


class StreamingDecoder:
    """feed(ids) gives the text that is complete; `last` gives what is left, unfinished characters as U+FFFD."""

    def __init__(self, table: list[bytes]):
        self.table, self.machine = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        table = self.table
        return self.machine.decode(b"".join([table[i] for i in ids if 0 <= i < len(table)]), last)


def _lists(rows: list[bytes]) -> pa.Array:
    """Rows of 32-bit ids as an Arrow array of lists."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


_LOT = 256


def encode_texts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    ship_package(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = streaming_encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _LOT):
                lot = batch.slice(at, _LOT)
                ids = encoder.encode([t or "" for t in lot.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([lot.column("doc_id"), _lists(ids)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_ids(coded: DataFrame, tokenizer_path: str, step: int = 65_536) -> DataFrame:
    """The columns of `coded` and text, from its column ids (array of int; null has no ids)."""
    ship_package(coded.sparkSession)
    names = [c for c in coded.columns if c != "text"]
    schema = coded.select(*[F.col(f"`{c}`") for c in names], F.lit("").alias("text")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _LOT):
                lot = batch.slice(at, _LOT)
                texts = []
                for ids in lot.column("ids"):
                    own, machine = ids.values, StreamingDecoder(table)
                    values = [] if own is None else own.to_numpy(zero_copy_only=False)
                    parts = [machine.feed(values[k : k + step].tolist(), k + step >= len(values)) for k in range(0, len(values), step)]
                    texts.append("".join(parts))
                columns = [lot.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return coded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(decode, schema)
