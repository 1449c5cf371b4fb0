"""N-gram Jaccard join: documents whose shingle sets are alike, exactly, and their connected components.

1. Sets. Each document's words (A-Z lower-cased) give the set of its distinct shingles as 64-bit hashes. Equal sets
   (by two independent 64-bit sums) form a class, named by its smallest id; only classes are compared.
2. Candidates without loss. In one order of all shingles (from rare to frequent by a table of counts of fixed size, then
   by hash), two sets whose Jaccard is at least t share a shingle
   among the first n - ceil(t * n) + 1 of each. Postings of these prefixes meet in hash buckets; shingles that only one
   set has there end here. The others get their sets' parity bitmaps and pairs pass filters of length, position and
   bitmap, as far as they connect more sets. Components of candidates are compared in cells of bounded size.
3. Signature trees. In a cell, sets lie in a tree whose nodes hold the OR of their shingle bitmaps, the range of their
   sizes and the most shingles that share a bit. Two trees (or one with itself) are traversed together; a pair of nodes is left out
   if its sizes can't reach t, if the bitmaps allow too small an overlap, or if all its sets are linked already.
   Pairs of sets that remain are verified by their shingles.
4. Verified links give the components of documents.

Null text and text without words have an empty set, link with nothing and are their own component. Fewer words than n
make one shingle. Rows with a null id get a null component and link nothing; rows that repeat an id are united under it. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compressed, ship_package, staged, trimmed
from .hashing import Words, chunks_by_bytes, from_packed_sorted, from_planes, mixed, packed_sorted, planes
from .links import CELL, FOUND, HOT_SETS, all_links, cells, components, links_of_bucket, parity_bitmaps, prefix_length
from .rarity import COUNT_COLUMNS, ONCE, Counter, classes_of, grouped_order, rarity_table

_FANOUT = 8
#: Salts that make independent hashes of one shingle.
_SALTS = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def shingle_sets(texts: list[bytes] | list[str], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of texts: index of the first text, (text index in chunk, shingle) sorted and distinct.

    Texts as str are encoded chunk by chunk, so that a batch is not held twice.
    """
    for part in chunks_by_bytes(texts):
        words = Words([(t if isinstance(t, bytes) else t.encode()).lower() for t in texts[part]])
        at, hashes = words.windows(n)
        owners, found = [words.text[at]], [hashes]
        counts = np.bincount(words.text, minlength=part.stop - part.start)
        for short in range(1, n):
            at, hashes = words.windows(short)
            whole = counts[words.text[at]] == short
            owners.append(words.text[at[whole]])
            found.append(mixed(hashes[whole] + np.uint64(short)))
        owner, shingle = np.concatenate(owners), np.concatenate(found)
        order = np.lexsort((shingle, owner))
        owner, shingle = owner[order], shingle[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
        yield part.start, owner[new], shingle[new]


def _sums(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    np.add.at(out, owner, values)
    return out


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows from one look at the texts.

    doc_id, n_shingles, low, high (the two sums that stand for the set) and bitmap (parity) for every row of docs; counts
    of hashed shingles (chunk, places, counts), a few a task.
    """

    names = ["doc_id", "n_shingles", "low", "high", "bitmap", "chunk", "places", "counts"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            size = np.zeros(len(texts), np.int64)
            low, high = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            bitmaps = [b""] * len(texts)
            for first, owner, shingle in shingle_sets(texts, n):
                counter.add(mixed(shingle ^ _SALTS[2]))
                sizes = np.bincount(owner)
                if len(sizes):  # without words in any text, np.split would still give one piece
                    at, held = parity_bitmaps(owner, shingle, sizes)
                    bitmaps[first : first + len(sizes)] = [m.tobytes() for m in np.split(held, at[1:-1])]
                owner = owner + first
                size += np.bincount(owner, minlength=len(texts))
                low += _sums(owner, mixed(shingle ^ _SALTS[0]), len(texts))
                high += _sums(owner, mixed(shingle ^ _SALTS[1]), len(texts))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_shingles": size, "low": low.view(np.int64), "high": high.view(np.int64), "bitmap": bitmaps}
            ).assign(chunk=None, places=None, counts=None)[names]
        yield counter.rows().assign(doc_id=None, n_shingles=None, low=None, high=None, bitmap=None)[names]

    return docs.select("doc_id", "text").mapInPandas(trimmed(scan), f"doc_id long, n_shingles long, low long, high long, bitmap binary, {COUNT_COLUMNS}")


def prefix_buckets(docs: DataFrame, rarity, n: int, percent: int, bucket_bits: int) -> DataFrame:
    """bucket, shingles, sets, sizes, places: packed postings of prefix shingles, each text once in a batch."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list({t for t in batch["text"] if t})
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for _, owner, shingle in shingle_sets(texts, n):
                size = np.bincount(owner)
                low = _sums(owner, mixed(shingle ^ _SALTS[0]), len(size))
                ranked = mixed(shingle ^ _SALTS[2])
                rare = classes_of(rarity.value, ranked)
                order = grouped_order(owner, ranked, rare)
                place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
                kept = (place < prefix_length(size, percent)[owner]) & (rare[order] > ONCE)
                parts.append((ranked[order][kept], low[owner[kept]], size[owner[kept]], place[kept]))
            shingle, low, size, place = (np.concatenate(column) for column in zip(*parts, strict=True))
            order = np.argsort(shingle, kind="stable")
            bucket = shingle[order] >> np.uint64(64 - bucket_bits)
            rows = [
                (int(shingle[own[0]] >> np.uint64(64 - bucket_bits)), packed_sorted(shingle[own]), planes(low[own]), planes(size[own]), planes(place[own]))
                for own in (np.split(order, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1) if len(order) else [])
            ]
            yield pd.DataFrame(rows, columns=["bucket", "shingles", "sets", "sizes", "places"])

    return docs.select("text").mapInPandas(trimmed(scan), "bucket int, shingles binary, sets binary, sizes binary, places binary")


def shared_postings(bucket: pd.DataFrame, percent: int) -> pd.DataFrame:
    """bucket, shingle, low, size, place of the postings whose shingle another set of like size has."""
    shingle = np.concatenate([from_packed_sorted(x) for x in bucket["shingles"]])
    low, size, place = (np.concatenate([from_planes(x) for x in bucket[c]]).view(np.int64) for c in ("sets", "sizes", "places"))
    order = np.lexsort((low, size, shingle))
    shingle, low, size, place = shingle[order], low[order], size[order], place[order]
    new = np.ones(len(low), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (low[1:] != low[:-1])
    shingle, low, size, place = shingle[new], low[new], size[new], place[new]
    near = (shingle[1:] == shingle[:-1]) & (100 * size[:-1] >= percent * size[1:])
    kept = np.zeros(len(low), bool)
    kept[1:] |= near
    kept[:-1] |= near
    return pd.DataFrame(
        {"bucket": bucket["bucket"].iloc[0], "shingle": shingle[kept].view(np.int64), "low": low[kept], "size": size[kept], "place": place[kept]}
    )


def candidate_links(bucket: pd.DataFrame, percent: int, hot_sets: int) -> pd.DataFrame:
    """Links that connect the sets of a bucket as far as the filters let pairs pass, and pieces of shingles with many sets."""
    held = np.frombuffer(b"".join(bucket["bitmap"]), np.uint64)
    low, size, place = (bucket[c].to_numpy(np.int64) for c in ("low", "size", "place"))
    return links_of_bucket(bucket["shingle"].to_numpy(np.int64).view(np.uint64), low, size, place, held, percent, hot_sets)


class Forest:
    """Union-find over items of a cell."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class SignatureTree:
    """Levels of nodes over sets in order of size and content: OR bitmaps, size ranges, most bit-sharing shingles."""

    def __init__(self, members: list[int], sets: list[np.ndarray], bits: int):
        self.members = sorted(members, key=lambda i: (len(sets[i]), int(sets[i][0])))
        words = bits // 64
        bitmaps = np.zeros((len(self.members), words), np.uint64)
        for row, i in zip(bitmaps, self.members, strict=True):
            place = sets[i] % np.uint64(bits)
            np.bitwise_or.at(row, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        size = np.array([len(sets[i]) for i in self.members])
        shared = size - np.bitwise_count(bitmaps).sum(axis=1).astype(np.int64)
        self.levels = [(bitmaps, size, size, shared)]
        while len(self.levels[-1][0]) > 1:
            bitmaps, low, high, shared = self.levels[-1]
            at = np.arange(0, len(bitmaps), _FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(bitmaps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(shared, at))
            )

    def children(self, level: int, node: int) -> range:
        return range(node * _FANOUT, min((node + 1) * _FANOUT, len(self.levels[level - 1][0])))

    def span(self, level: int, node: int) -> range:
        width = _FANOUT**level
        return range(node * width, min((node + 1) * width, len(self.members)))


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
    return 100 * common >= percent * (len(x) + len(y) - common)


def linked_pairs(sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among sets (sorted, distinct, not empty) of one or two sides."""
    forest, links = Forest(len(sets)), []
    bits = 1 << max(8, (4 * max(map(len, sets)) - 1).bit_length())
    trees = [SignatureTree([i for i, s in enumerate(sides) if s == side], sets, bits) for side in sorted(set(sides))]
    left, right = trees[0], trees[-1]

    def one_root(tree: SignatureTree, level: int, node: int) -> int | None:
        members = iter(tree.span(level, node))
        root = forest.root(tree.members[next(members)])
        return root if all(forest.root(tree.members[i]) == root for i in members) else None

    def leaf_pairs(one: SignatureTree, la: int, a: int, other: SignatureTree, lb: int, b: int) -> list[tuple[int, int]]:
        """Pairs of sets below two lowest nodes whose sizes and bitmaps allow a link."""
        rows, columns = (np.array(t.span(level, node)) for t, level, node in ((one, la, a), (other, lb, b)))
        x, size_x, _, shared_x = (v[rows] for v in one.levels[0])
        y, size_y, _, shared_y = (v[columns] for v in other.levels[0])
        most = np.bitwise_count(x[:, None] & y[None]).sum(axis=-1).astype(np.int64) + np.minimum(shared_x[:, None], shared_y[None])
        most = np.minimum(most, np.minimum(size_x[:, None], size_y[None]))
        fit = 100 * most >= percent * (size_x[:, None] + size_y[None] - most)
        return [(one.members[rows[i]], other.members[columns[j]]) for i, j in np.argwhere(fit).tolist()]

    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        bits_a, low_a, high_a, shared_a = (x[a] for x in left.levels[la])
        bits_b, low_b, high_b, shared_b = (x[b] for x in right.levels[lb])
        if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
            continue
        most = min(int(np.bitwise_count(bits_a & bits_b).sum()) + min(int(shared_a), int(shared_b)), int(high_a), int(high_b))
        if 100 * most < percent * (max(int(low_a), most) + max(int(low_b), most) - most):
            continue
        if la <= 1 and lb <= 1:
            for i, j in leaf_pairs(left, la, a, right, lb, b):
                if i != j and forest.root(i) != forest.root(j) and alike(sets[i], sets[j], percent):
                    forest.join(i, j)
                    links.append((i, j))
            continue
        known = one_root(left, la, a)
        if known is not None and known == one_root(right, lb, b):
            continue
        if la >= lb:
            pairs = [(la - 1, c, lb, b) for c in left.children(la, a)]
            if left is right and la == lb and a == b:
                kids = left.children(la, a)
                pairs = [(la - 1, c, la - 1, d) for c in kids for d in kids if c <= d]
        else:
            pairs = [(la, a, lb - 1, d) for d in right.children(lb, b)]
        stack += pairs
    return links


def ngram_join(docs: DataFrame, n: int = 3, percent: int = 90, bucket_bytes: int = 4 << 20, cell_items: int = 512, hot_sets: int = HOT_SETS) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id for every row of docs."""
    ship_package(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = staged(document_sets(own, n), "shingle-sets")
    sets = seen.filter("chunk is null").drop("chunk", "places", "counts")
    rarity = docs.sparkSession.sparkContext.broadcast(rarity_table(seen.filter("chunk is not null").select("chunk", "places", "counts")))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bucket_bits = max(3, (total // bucket_bytes).bit_length())
    classes = (
        sets.filter("n_shingles > 0 and doc_id is not null").groupBy("low", "high").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("size"))
    )
    classes = staged(classes, "classes")
    shared = (
        prefix_buckets(own.filter("doc_id is not null"), rarity, n, percent, bucket_bits)
        .groupBy("bucket")
        .applyInPandas(lambda bucket: shared_postings(bucket, percent), "bucket int, shingle long, low long, size long, place long")
    )
    sketches = sets.filter("n_shingles > 0").groupBy("low").agg(F.first("bitmap").alias("bitmap"))
    found = shared.join(sketches, "low").groupBy("bucket").applyInPandas(lambda bucket: candidate_links(bucket, percent, hot_sets), FOUND)
    candidates = components(all_links(staged(found, "candidate-links"), percent))
    members = classes.join(candidates.withColumnRenamed("node", "low"), "low").select("root", F.col("class_id").alias("item"), "low")
    members = staged(members, "candidates")
    sizes = members.groupBy("root").agg(F.count("*").alias("items")).filter("items > 1")
    # Texts move compressed, by a merge join at every size: a broadcast on small inputs alone would hide what large ones shuffle.
    packed = own.select("doc_id", compressed(F.col("text")).alias("packed"))
    shown = packed.hint("merge").join(members.join(sizes, "root").select("root", "item", "low"), F.col("doc_id") == F.col("item"))

    def as_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [unpack(t) if t is not None else b"" for t in batch["packed"]]
            out: list[bytes] = []
            for first, owner, shingle in shingle_sets(texts, n):
                out += [b""] * (first - len(out))
                ends = np.cumsum(np.bincount(owner, minlength=0))
                out += [s.tobytes() for s in np.split(shingle, ends[:-1])] if len(ends) else []
            out += [b""] * (len(texts) - len(out))
            sums = [int(mixed(np.frombuffer(s, np.uint64) ^ _SALTS[0]).sum(dtype=np.uint64).view(np.int64)) for s in out]
            # A row that repeats its id with another text is not the class's set.
            yield batch.assign(shingles=out)[batch["low"] == sums].drop(columns="packed")

    shipped = shown.select("root", "item", "low", "packed").mapInPandas(trimmed(as_sets), "root long, item long, low long, shingles binary")

    def compare(_: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for _, cell in lot.drop_duplicates([*CELL, "item", "low"]).groupby(CELL):
            if len(cell) > 1:
                arrays = [np.frombuffer(s, np.uint64) for s in cell["shingles"]]
                items = cell["item"].tolist()
                links += [(items[i], items[j]) for i, j in linked_pairs(arrays, cell["block"].tolist(), percent)]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    links = cells(shipped, sizes, cell_items).groupBy("lot").applyInPandas(compare, "a long, b long")
    joined = components(links)
    named = classes.join(joined, F.col("class_id") == F.col("node"), "left").select("low", "high", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    empty = F.col("n_shingles") == 0
    return (
        sets.join(named, ["low", "high"], "left")
        .withColumn("class_id", F.when(empty, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("class_id"))))
        .withColumn("component_id", F.when(empty, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id"))))
        .select("doc_id", "n_shingles", "class_id", "component_id")
    )
