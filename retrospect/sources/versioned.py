"""Tables with versions: data files that never change, and a numbered manifest a commit.

A manifest lists the data folders of each part of the table. A part is a bucket of the key's hash or one value of a
slice column, so a change reads and writes only the parts that it touches, and a reader of version n sees exactly what
manifest n lists. A commit writes its data folders first, then its manifest under a name of its own, and renames this to
the next number; the rename fails where the number exists. A writer that loses takes the winner's manifest as its new
base if the two touched different parts, and otherwise does its work again over the new version. A job that dies before
the rename leaves folders that no manifest lists, which no reader sees and `orphans` names. The store has to offer a
rename that refuses an existing target, as HDFS does; a plain object store does not.

A manifest also holds a ledger, the last batch number of each writer: a batch that is given again changes nothing.
Only part names and manifests pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .changes import conflicts, missing_rows, upserted

_PART = "__part"


class ConflictError(ValueError):
    """A batch holds keys that are stored with other values, or holds a key twice."""


class LostRaceError(RuntimeError):
    """Other writers touched the same parts in every attempt."""


@dataclass
class Manifest:
    version: int
    schema: str
    keys: list[str]
    buckets: int
    slice_column: str | None
    operation: str
    changed: list[str] = field(default_factory=list)
    parts: dict[str, list[str]] = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table under `path`; make one with `create`, open it with the constructor."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64, slice_column: str | None = None) -> VersionedTable:
        """An empty table (version 0), dealt to buckets of its key or to the values of a slice column."""
        table = cls(spark, path)
        table._publish(Manifest(0, schema.json(), keys, buckets, slice_column, "create"))
        return table

    # Manifests

    def _log(self, name: str):
        return self._hadoop.Path(f"{self.path}/log/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._log("")):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(self._log(""))]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        stream = self._fs.open(self._log(f"{self.versions()[-1] if version is None else version:020d}.json"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, manifest: Manifest) -> bool:
        """Make this the manifest of its version; False if the version exists."""
        waiting = self._log(f"{uuid.uuid4().hex}.waiting")
        out = self._fs.create(waiting, False)
        out.write(json.dumps(manifest.__dict__).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._context.rename(waiting, self._log(f"{manifest.version:020d}.json"), none)
        except Py4JJavaError as error:
            self._fs.delete(waiting, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    # Reading

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The table as of a version (the newest by default), or only some of its parts."""
        return self._read(self.manifest(version), parts)

    def _read(self, manifest: Manifest, parts: list[str] | None = None) -> DataFrame:
        wanted = manifest.parts if parts is None else {p: manifest.parts[p] for p in parts if p in manifest.parts}
        return self._files([f"{self.path}/{folder}" for folders in wanted.values() for folder in folders], manifest)

    def _files(self, paths: list[str], manifest: Manifest) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def added(self, version: int) -> DataFrame:
        """What a version holds in folders that the one before lacks: the rows it appended or wrote anew."""
        now, before = self.manifest(version), self.manifest(version - 1)
        known = {folder for folders in before.parts.values() for folder in folders}
        return self._files([f"{self.path}/{f}" for folders in now.parts.values() for f in folders if f not in known], now)

    def orphans(self) -> list[str]:
        """Data folders that no version lists, left by writers that died or lost a race."""
        data = self._hadoop.Path(f"{self.path}/data")
        found = {f"data/{s.getPath().getName()}" for s in self._fs.listStatus(data)} if self._fs.exists(data) else set()
        used = {folder.rpartition("/")[0] for v in self.versions() for folders in self.manifest(v).parts.values() for folder in folders}
        return sorted(found - used)

    # Writing

    def _part(self, manifest: Manifest) -> Column:
        if manifest.slice_column:
            return F.coalesce(F.md5(F.col(f"`{manifest.slice_column}`").cast("string")), F.lit("none"))
        return F.format_string("%06d", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in manifest.keys]), F.lit(manifest.buckets)))

    def _written(self, rows: DataFrame, manifest: Manifest) -> dict[str, str]:
        """Write rows to a new data folder; the folder of each part that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(_PART, self._part(manifest)).repartition(_PART)
        dealt.write.partitionBy(_PART).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        names = [status.getPath().getName() for status in self._fs.listStatus(self._hadoop.Path(f"{self.path}/{folder}"))]
        return {name.partition("=")[2]: f"{folder}/{name}" for name in names if name.startswith(f"{_PART}=")}

    def _checked(self, batch: DataFrame, manifest: Manifest) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        rows = batch.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
        twice = rows.groupBy(*manifest.keys).count().filter("count > 1").select(*manifest.keys).take(5)
        if twice:
            raise ConflictError(f"the batch holds keys twice, such as {[tuple(row) for row in twice]}")
        return rows

    def _commit(self, operation: str, prepare: Callable, batch_of: tuple[str, int] | None, attempts: int = 5) -> int:
        """Prepare changes over the newest version and publish them; the version that holds them.

        prepare(manifest) gives the parts that were touched, and for each the folders that it has from now on.
        """
        for _ in range(attempts):
            base = self.manifest()
            if batch_of and base.ledger.get(batch_of[0], -1) >= batch_of[1]:
                return base.version
            touched, changes = prepare(base)
            while True:
                parts = {p: f for p, f in (base.parts | changes).items() if f}
                ledger = base.ledger | ({batch_of[0]: batch_of[1]} if batch_of else {})
                made = Manifest(base.version + 1, base.schema, base.keys, base.buckets, base.slice_column, operation, sorted(touched), parts, ledger)
                if self._publish(made):
                    return made.version
                winner = self.manifest(base.version + 1)
                known = batch_of and winner.ledger.get(batch_of[0], -1) >= batch_of[1]
                if known or touched & set(winner.changed):
                    break  # the work was done over parts that have changed since, or by someone else
                base = winner
        raise LostRaceError(f"{operation}: other writers changed the same parts in {attempts} attempts")

    def _touched(self, rows: DataFrame, manifest: Manifest) -> set[str]:
        return {row[0] for row in rows.select(self._part(manifest)).distinct().collect()}

    def upsert(self, batch: DataFrame, batch_of: tuple[str, int] | None = None) -> int:
        """A batch's row replaces the stored row of its key; the parts that hold the batch's keys are written anew."""

        def prepare(base: Manifest) -> tuple[set[str], dict[str, list[str]]]:
            rows = self._checked(batch, base)
            touched = self._touched(rows, base)
            files = self._written(upserted(self._read(base, sorted(touched)), rows, base.keys), base)
            return touched, {part: [folder] for part, folder in files.items()}

        return self._commit("upsert", prepare, batch_of)

    def insert(self, batch: DataFrame, batch_of: tuple[str, int] | None = None) -> int:
        """Append the rows whose key is not stored; a stored row that differs from the batch's refuses the whole commit."""

        def prepare(base: Manifest) -> tuple[set[str], dict[str, list[str]]]:
            rows = self._checked(batch, base)
            touched = self._touched(rows, base)
            stored = self._read(base, sorted(touched))
            refused = conflicts(stored, rows, base.keys).take(5)
            if refused:
                raise ConflictError(f"stored rows differ from the batch, such as {[tuple(row) for row in refused]}")
            files = self._written(missing_rows(stored, rows, base.keys), base)
            return touched, {part: [*base.parts.get(part, []), folder] for part, folder in files.items()}

        return self._commit("insert", prepare, batch_of)

    def append_new(self, batch: DataFrame, batch_of: tuple[str, int] | None = None) -> int:
        """Append the rows whose key is neither stored nor earlier in the batch, and pass over the others."""

        def prepare(base: Manifest) -> tuple[set[str], dict[str, list[str]]]:
            rows = batch.select(*[F.col(f"`{f.name}`") for f in T.StructType.fromJson(json.loads(base.schema))]).dropDuplicates(base.keys)
            touched = self._touched(rows, base)
            files = self._written(missing_rows(self._read(base, sorted(touched)), rows, base.keys), base)
            return touched, {part: [*base.parts.get(part, []), folder] for part, folder in files.items()}

        return self._commit("append", prepare, batch_of)

    def replace_slices(self, batch: DataFrame, emptied: DataFrame | None = None, batch_of: tuple[str, int] | None = None) -> int:
        """The batch's slices take the place of the stored ones; `emptied` (the slice column) names slices to end without rows."""

        def prepare(base: Manifest) -> tuple[set[str], dict[str, list[str]]]:
            if not base.slice_column:
                raise ValueError("only a table with a slice column has slices to replace")
            rows = self._checked(batch, base)
            gone = self._touched(emptied, base) if emptied is not None else set()
            files = self._written(rows, base)
            return gone | set(files), {**dict.fromkeys(gone, []), **{part: [folder] for part, folder in files.items()}}

        return self._commit("replace", prepare, batch_of)
