"""Hash trees over row fingerprints: one root for a set of rows, and differences found where hashes differ only.

A row's fingerprint says all its columns, nulls apart from texts. Equal rows are one entry with a number of copies.
Entries are dealt to buckets by the first digits of their fingerprints, so buckets are even whatever keys are hot; a
bucket's hash covers its sorted entries, and each level above covers the sorted hashes of at most 256 nodes. The root
depends neither on the order of rows nor on their partitions, and no task holds more than a bucket or 256 nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DIGITS = 2  # hexadecimal digits of a level
BUCKET = 4096  # entries that a bucket should hold on average
NODE = "prefix string, n_rows bigint, hash string"
PUSHED = 256  # differing nodes that are named in the next level's scan; more are joined


def levels_for(n_rows: int) -> int:
    """Levels below the root with which buckets hold BUCKET entries or fewer on average."""
    levels = 0
    while n_rows > BUCKET * 16 ** (DIGITS * levels):
        levels += 1
    return levels


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the columns, each spelled as its length, a colon and its text; null is a dash."""
    text = [F.col(c).cast("string") for c in columns]
    spelled = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text]
    return F.sha2(F.concat_ws("|", *spelled).cast("binary"), 256)


def entries(rows: DataFrame, columns: list[str], kept: list[str]) -> DataFrame:
    """The kept columns, fingerprint and copies of distinct rows; kept are among the columns."""
    return rows.groupBy(*kept, fingerprint(columns).alias("fingerprint")).agg(F.count("*").alias("copies"))


def _combined(parts: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(parts)), "|").cast("binary"), 256)


def _buckets(found: DataFrame, levels: int, group: list[str]) -> DataFrame:
    entry = F.concat_ws("*", "fingerprint", F.col("copies").cast("string"))
    bucket = F.left("fingerprint", F.lit(DIGITS * levels)).alias("prefix")
    return found.groupBy(*group, bucket).agg(F.sum("copies").alias("n_rows"), _combined(entry).alias("hash"))


def _parents(nodes: DataFrame, level: int, group: list[str]) -> DataFrame:
    above = F.left("prefix", F.lit(DIGITS * level)).alias("prefix")
    return nodes.groupBy(*group, above).agg(F.sum("n_rows").alias("n_rows"), _combined(F.concat_ws(":", "prefix", "hash")).alias("hash"))


def roots(rows: DataFrame, columns: list[str], group: str, levels: int) -> DataFrame:
    """group, n_rows and root hash of the rows of each group. Null is a group; an empty table has none."""
    nodes = _buckets(entries(rows, columns, [group]), levels, [group])
    for level in range(levels - 1, -1, -1):
        nodes = _parents(nodes, level, [group])
    return nodes.select(group, "n_rows", F.col("hash").alias("root"))


@dataclass(frozen=True)
class HashTree:
    """A tree that was written: entries by their first digits, nodes by level."""

    path: str
    levels: int
    keys: tuple[str, ...]
    schema: StructType

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/entries")

    def nodes(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.schema(NODE).parquet(f"{self.path}/nodes-{level}")

    def root(self, spark: SparkSession) -> str | None:
        """The root's hash, None of an empty table."""
        found = self.nodes(spark, 0).first()
        return found and found["hash"]


def write_tree(rows: DataFrame, keys: list[str], columns: list[str], path: str, levels: int) -> HashTree:
    """Writes the tree of the rows' columns; keys are what a difference names. Trees are compared at equal levels only."""
    spark = rows.sparkSession
    part = F.left("fingerprint", F.lit(DIGITS * min(levels, 1)))
    folder = F.when(part == "", "all").otherwise(F.concat(F.lit("x"), part))  # a name that is read back as text
    dealt = entries(rows, columns, keys).withColumn("part", folder).repartitionByRange("fingerprint")
    dealt.sortWithinPartitions("fingerprint").write.partitionBy("part").parquet(f"{path}/entries")
    tree = HashTree(path, levels, tuple(keys), dealt.schema)
    nodes = _buckets(tree.entries(spark), levels, [])
    for level in range(levels, -1, -1):
        nodes.write.parquet(f"{path}/nodes-{level}")
        nodes = _parents(tree.nodes(spark, level), level - 1, []) if level else nodes
    return tree


def _within(rows: DataFrame, prefix: Column, differing: DataFrame, known: list[str] | None) -> DataFrame:
    if known is not None:
        return rows.filter(prefix.isin(known))
    return rows.withColumn("__prefix", prefix).join(differing.select(F.col("prefix").alias("__prefix")), "__prefix", "left_semi").drop("__prefix")


def tree_diff(spark: SparkSession, old: HashTree, new: HashTree) -> DataFrame:
    """keys and change of the rows that differ: ADDED where a key only gained rows (copies count), REMOVED where it only lost some, else CHANGED.

    Goes down from the roots; below a node of equal hash nothing is read. At most PUSHED names of nodes reach the driver.
    Null keys are keys; with an empty table every key of the other is ADDED or REMOVED.
    """
    if (old.levels, old.keys) != (new.levels, new.keys):
        raise ValueError("trees of different levels or keys cannot be compared")
    keys = list(old.keys)
    differing, known = None, None
    for level in range(old.levels + 1):
        sides = [tree.nodes(spark, level).select("prefix", F.col("hash").alias(name)) for tree, name in ((old, "was"), (new, "is"))]
        if level:
            sides = [_within(side, F.left("prefix", F.lit(DIGITS * (level - 1))), differing, known) for side in sides]
        differing = sides[0].join(sides[1], "prefix", "full_outer").filter(~F.equal_null("was", "is")).select("prefix")
        first = [r["prefix"] for r in differing.limit(PUSHED + 1).collect()]
        known = first if len(first) <= PUSHED else None
        if not first:
            break
    parts = sorted({f"x{p[:DIGITS]}" if p else "all" for p in known}) if known is not None else None
    signed = []
    for sign, tree in ((-1, old), (1, new)):
        rows = tree.entries(spark) if parts is None else tree.entries(spark).filter(F.col("part").isin(parts))
        rows = _within(rows, F.left("fingerprint", F.lit(DIGITS * old.levels)), differing, known)
        signed.append(rows.select(*keys, "fingerprint", (F.col("copies") * sign).alias("copies")))
    left = signed[0].unionByName(signed[1]).groupBy(*keys, "fingerprint").agg(F.sum("copies").alias("copies")).filter("copies <> 0")
    gained, lost = F.max(F.col("copies") > 0), F.max(F.col("copies") < 0)
    return left.groupBy(*keys).agg(F.when(gained & lost, "CHANGED").when(gained, "ADDED").otherwise("REMOVED").alias("change"))
