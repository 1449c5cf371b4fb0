"""Line dedup: lines whose word sets are alike to an earlier line's anywhere in the corpus are removed.

A line's set holds its distinct words. Two lines match if the Jaccard of their sets is at least percent / 100; order
is that of (doc_id, line number). A line that matches an earlier line of the input is removed.

1. Rarity. A table of fixed size counts hashed words over all lines. It gives one order of words for all lines, from
   rare to frequent. The same pass names each line by two sums over its words; lines with equal words are one from here.
2. Candidates. Words of a line are put in that order; two lines that match share a word among the first
   n - ceil(t * n) + 1 of each (and fewer of the smaller one). Postings of these prefixes meet in hash buckets. Pairs
   there pass the length filter, the positional filter, and a filter by parity bitmaps (their Hamming distance is at
   most the sets' difference), and are kept only as far as they connect more lines. A word with very many lines is
   dealt to pieces of bounded size. Components of candidates are compared in cells of bounded size.
3. Verification. In a cell, earlier lines in order are compared with the later ones that are still open: length filter,
   then the exact Jaccard.
4. The first line with a set stays unless an earlier set matches; all later lines with the same set go.

Lines without words stay. Null text stays null. Rows with a null id are left as they are and remove nothing. Rows that
repeat an id are ordered by a hash of their text; equal rows count once. An empty table gives no rows. All columns of
docs are returned, whatever their names, and the struct `result` (n_lines, n_removed) is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, compressed, ship_package, staged, trimmed
from .hashing import Words, chunks_by_bytes, counted, from_packed_sorted, from_planes, mixed, packed_sorted, planes
from .links import CELL, FOUND, all_links, bitmap_words, cells, components, links_of_bucket, parity_bitmaps, prefix_length, ragged
from .rarity import COUNT_COLUMNS, ONCE, Counter, classes_of, grouped_order, rarity_table

#: Salts of two independent hashes of one word.
_SALTS = tuple(np.uint64(x) for x in (0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9))


class Lines:
    """Lines with words of a list of texts: text index, line number, and place and number of each line's words."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(words.data, np.uint8) == 10) + 1])
        home = counted(words.start, starts)
        self.word = words.hash
        self.first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
        self.many = np.diff(self.first, append=len(home))
        self.text = words.text[self.first]
        self.number = home[self.first] - (np.searchsorted(starts, words.first, side="right") - 1)[self.text]

    def sums(self, salt: np.uint64) -> np.ndarray:
        """One number for each line from its words, whatever their order."""
        return np.add.reduceat(mixed(self.word ^ salt), self.first) if len(self.first) else np.zeros(0, np.uint64)

    def ranked(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, word and rarity of the distinct words of every line, each line's from rare to frequent."""
        line = np.repeat(np.arange(len(self.first)), self.many)
        rare = classes_of(classes, self.word)
        order = grouped_order(line, self.word, rare)
        line, word = line[order], self.word[order]
        new = np.ones(len(order), bool)
        new[1:] = (line[1:] != line[:-1]) | (word[1:] != word[:-1])
        return line[new], word[new], rare[order][new]


def _chunks(texts: pd.Series) -> Iterator[tuple[int, Lines]]:
    encoded = [t.encode() if t else b"" for t in texts]
    for part in chunks_by_bytes(encoded):
        yield part.start, Lines(encoded[part])


_FIRST_PASS = f"doc_id long, text_key long, line int, low long, high long, {COUNT_COLUMNS}"
_FIRST_PASS_NAMES = [column.split()[0] for column in _FIRST_PASS.split(", ")]


def first_pass(docs: DataFrame) -> DataFrame:
    """Two kinds of rows from one look at the texts.

    Lines with words: doc_id, text_key, line, low, high. Counts of hashed words (chunk, places, counts), a few a task.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter()
        for batch in batches:
            ids, keys = batch["doc_id"].to_numpy(), batch["text_key"].to_numpy()
            for first, lines in _chunks(batch["text"]):
                counter.add(lines.word)
                at = lines.text + first
                low, high = (lines.sums(salt).view(np.int64) for salt in _SALTS)
                yield pd.DataFrame({"doc_id": ids[at], "text_key": keys[at], "line": lines.number, "low": low, "high": high}).assign(
                    chunk=None, places=None, counts=None
                )
        yield counter.rows().assign(doc_id=None, text_key=None, line=None, low=None, high=None)[_FIRST_PASS_NAMES]

    return docs.select("doc_id", "text_key", "text").mapInPandas(trimmed(scan), _FIRST_PASS)


def prefix_postings(docs: DataFrame, rarity, percent: int, bucket_bits: int) -> DataFrame:
    """bucket, words, lines, sizes, places, bitmaps: packed postings of prefix words, each line's words once in a batch."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = rarity.value
        for batch in batches:
            parts, maps, base = [], [np.zeros(0, np.uint64)], 0
            for _, lines in _chunks(batch["text"]):
                line, word, rare = lines.ranked(classes)
                size = np.bincount(line, minlength=len(lines.first))
                place = np.arange(len(line)) - (np.cumsum(size) - size)[line]
                low = lines.sums(_SALTS[0])
                once = np.zeros(len(low), bool)
                once[np.unique(low, return_index=True)[1]] = True
                keep = (place < prefix_length(size, percent)[line]) & (rare > ONCE) & once[line]
                first, bitmaps = parity_bitmaps(line, word, size)
                line = line[keep]
                parts.append([word[keep], low[line], size[line], place[keep], first[line] + base])
                maps.append(bitmaps)
                base += len(bitmaps)
            if not parts:
                continue
            word, low, size, place, first = (np.concatenate(column) for column in zip(*parts, strict=True))
            bitmaps = np.concatenate(maps)
            order = np.argsort(word)
            bucket = word[order] >> np.uint64(64 - bucket_bits)
            rows = []
            for own in np.split(order, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1) if len(order) else []:
                held = bitmaps[ragged(first[own], bitmap_words(size[own]))]
                number = int(word[own[0]] >> np.uint64(64 - bucket_bits))
                rows.append((number, packed_sorted(word[own]), planes(low[own]), planes(size[own]), planes(place[own]), held.tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "words", "lines", "sizes", "places", "bitmaps"])

    schema = "bucket int, words binary, lines binary, sizes binary, places binary, bitmaps binary"
    return docs.select("text").mapInPandas(trimmed(scan), schema)


def candidate_links(bucket: pd.DataFrame, percent: int, hot_lines: int) -> pd.DataFrame:
    """Links that connect the lines of a bucket as far as the filters let pairs pass, and pieces of words with many lines."""
    column = lambda name: np.concatenate([from_planes(x) for x in bucket[name]]).view(np.int64)
    word = np.concatenate([from_packed_sorted(x) for x in bucket["words"]])
    held = np.concatenate([np.frombuffer(x, np.uint64) for x in bucket["bitmaps"]])
    return links_of_bucket(word, column("lines"), column("sizes"), column("places"), held, percent, hot_lines)


def later_matches(words: np.ndarray, first: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Positions of the lines that match an earlier one; a line is `size` sorted distinct words from `first` on."""
    open_ = np.arange(1, len(size))
    gone = []
    for leader in range(len(size) - 1):
        open_ = open_[open_ > leader]
        if not len(open_):
            break
        n = size[leader]
        like = open_[100 * np.minimum(size[open_], n) >= percent * np.maximum(size[open_], n)]
        if not len(like):
            continue
        own = words[first[leader] : first[leader] + n]
        others = words[ragged(first[like], size[like])]
        hit = own[np.minimum(np.searchsorted(own, others), n - 1)] == others
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[like]) - size[like])
        found = like[100 * common >= percent * (size[like] + n - common)]
        if len(found):
            gone.append(found)
            open_ = np.setdiff1d(open_, found, assume_unique=True)
    return np.concatenate(gone) if gone else np.zeros(0, np.int64)


def dedup_lines(
    docs: DataFrame, percent: int = 80, bucket_bytes: int = 8 << 20, cell_items: int = 2048, hot_lines: int = 16_384, result: str = "line_dedup"
) -> DataFrame:
    """docs with the lines left in `text`, and the struct `result` (n_lines, n_removed)."""
    spark = docs.sparkSession
    ship_package(spark)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        "text",
    )
    own = whole.filter("doc_id is not null and text is not null").select("doc_id", "text_key", "text")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bucket_bits = max(3, (total // bucket_bytes).bit_length())
    seen = staged(first_pass(own), "line-sets")
    sets = seen.filter("chunk is null").select("doc_id", "text_key", "line", "low", "high")
    rarity = spark.sparkContext.broadcast(rarity_table(seen.filter("chunk is not null").select("chunk", "places", "counts")))
    found = staged(
        prefix_postings(own, rarity, percent, bucket_bits)
        .groupBy("bucket")
        .applyInPandas(lambda _, bucket: candidate_links(bucket, percent, hot_lines), FOUND),
        "candidate-links",
    )
    candidates = components(all_links(found, percent)).withColumnRenamed("node", "low")
    firsts = staged(sets.groupBy("low", "high").agg(F.min(F.struct("doc_id", "text_key", "line")).alias("first")), "first-lines")
    members = staged(firsts.join(candidates, "low").select("root", "low", "high", "first"), "candidate-lines")
    sizes = members.groupBy("root").agg(F.count("*").alias("items")).filter("items > 1")
    wanted = (
        members.join(sizes, "root")
        .groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
        .agg(F.collect_list(F.struct("first.line", "root", "low", "high")).alias("wanted"))
    )
    packed = own.select("doc_id", "text_key", compressed(F.col("text")).alias("packed"))

    def words_of_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, lines = [], []
            for doc_id, key, data, asked in zip(batch["doc_id"], batch["text_key"], batch["packed"], batch["wanted"], strict=True):
                text = unpack(data).split(b"\n")
                lines += [text[one["line"]] for one in asked]
                rows += [(one["root"], one["low"], one["high"], doc_id, key, one["line"]) for one in asked]
            for part in chunks_by_bytes(lines):
                words = Words(lines[part])
                order = grouped_order(words.text, words.hash)
                home, word = words.text[order], words.hash[order]
                new = np.ones(len(order), bool)
                new[1:] = (home[1:] != home[:-1]) | (word[1:] != word[:-1])
                ends = np.cumsum(np.bincount(home[new], minlength=part.stop - part.start))
                frame = pd.DataFrame(rows[part], columns=["root", "item", "high", "doc_id", "text_key", "line"])
                yield frame.assign(words=[x.tobytes() for x in np.split(word[new], ends[:-1])])

    once = packed.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    shipped = once.mapInPandas(trimmed(words_of_lines), "root long, item long, high long, doc_id long, text_key long, line int, words binary")

    def compare(_: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        lot = lot.sort_values([*CELL, "doc_id", "text_key", "line"])
        cell = lot[CELL].to_numpy()
        words = np.frombuffer(b"".join(lot["words"]), np.uint64)
        size = lot["words"].map(len).to_numpy() // 8
        first = np.cumsum(size) - size
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(lot)]
        gone = [a + later_matches(words, first[a:b], size[a:b], percent) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
        matched = np.concatenate(gone) if gone else np.zeros(0, np.int64)
        return lot.iloc[matched][["item", "high"]].rename(columns={"item": "low"})

    gone = cells(shipped, sizes, cell_items).groupBy("lot").applyInPandas(compare, "low long, high long").distinct()
    # What stays is one line a set, so no line that many documents share is joined; a document with as many lines left as it
    # had needs no change.
    kept = (
        firsts.join(gone, ["low", "high"], "left_anti")
        .groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
        .agg(F.collect_list("first.line").alias("kept"))
    )
    counts = sets.groupBy("doc_id", "text_key").agg(F.count("*").alias("lines"))
    joined = whole.join(counts.join(kept, ["doc_id", "text_key"], "left"), ["doc_id", "text_key"], "left")
    changed = F.col("lines") > F.coalesce(F.size("kept"), F.lit(0))
    stays = lambda line, i: F.coalesce(F.array_contains("kept", i), F.lit(False)) | (F.translate(line, SPACES, "") == "")
    judged = joined.withColumn("left", F.when(changed, F.filter(F.split("text", "\n"), stays)))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long")
    n_removed = F.when(F.col("left").isNull(), 0).otherwise(n_lines - F.size("left")).cast("long")
    text = F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    names = [text.alias(c) if c == "text" else F.col(f"others.`{c}`").alias(c) for c in docs.columns]
    return judged.select(*names, F.struct(n_lines.alias("n_lines"), n_removed.alias("n_removed")).alias(result))
