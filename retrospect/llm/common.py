"""What the training-data operators share: the shared scratch folder, word rules and table reading."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule (space, tab, line feed, vertical tab, form feed, carriage return).
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary folder, which only local mode may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_scratch.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application, unless PYTHONPATH has it for them already."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in known or context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "retrospect.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "retrospect").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def trimmed(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A scan for mapInPandas whose worker gives the memory of its batches back to the system at the task's end.

    Workers stay for the stages that follow; what their allocators keep would add up to the memory of these.
    """

    def run(batches: Iterator) -> Iterator:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def compressed(text: Column) -> Column:
    """Text as zstd bytes, for shuffles that carry whole texts; null stays null."""

    @F.pandas_udf("binary")
    def compress(texts: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return pd.Series([None if t is None else pack(t.encode()) for t in texts], dtype=object)

    return compress(text)
