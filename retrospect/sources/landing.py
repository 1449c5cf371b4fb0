"""Landed files: CSV with quotes over lines and bad bytes, JSON lines and binary documents, each with a table of rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a corpus file, in its order, and the kinds of text it holds.
CORPUS = "date string, released string, kind string, text string"
KINDS = ["Statement", "Minute"]
FEED = "series_id string, date date, value string, realtime_start date, realtime_end date"

Split = tuple[DataFrame, DataFrame]


def _split(rows: DataFrame, rules: dict[str, object]) -> Split:
    """Rows that break no rule, and file, position, raw and the first broken rule of the others."""
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    judged = rows.withColumn("reason", reason)
    rejected = judged.filter("reason is not null").select("file", "position", "raw", "reason")
    return judged.filter("reason is null").drop("reason", "raw"), rejected


def _placed(rows: DataFrame) -> DataFrame:
    """rows with the file and the position of each in it: larger is later, positions are not gapless."""
    return rows.withColumn("file", F.col("_metadata.file_path")).withColumn("position", F.monotonically_increasing_id())


def landed_corpus(spark: SparkSession, path: str) -> Split:
    """Accepted rows (the corpus columns, file, position) and rejected ones of the CSV files under a path.

    Files have a header; a quote is doubled inside quotes; text may go over lines, so a file is read by one task and
    large landings come in many files. Bytes that are no UTF-8 become U+FFFD and the row stays. Rejected are COLUMNS
    (more or fewer than the header's), NO_DATE and KIND. A field without quotes that is empty is
    null, a quoted one is an empty text.
    """
    read = spark.read.schema(f"{CORPUS}, raw string").options(
        header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="raw",
        recursiveFileLookup=True, columnPruning=False, nullValue="\u0000",
    )
    no_date = F.col("date").isNull() | (F.trim("date") == "")
    kind = ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False))
    return _split(_placed(read.csv(path)), {"COLUMNS": F.col("raw").isNotNull(), "NO_DATE": no_date, "KIND": kind})


def landed_feed(spark: SparkSession, path: str) -> Split:
    """Accepted observations (series_id, date, value_raw, realtime_start, realtime_end) and rejected lines of JSON files.

    A value is kept as its text, "." included. Rejected are PARSE (a line that is no JSON object or has a date that is
    none) and NO_KEY (series or date missing). Lines are split over tasks.
    """
    read = spark.read.schema(f"{FEED}, raw string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="raw", recursiveFileLookup=True)
    no_key = F.col("series_id").isNull() | F.col("date").isNull()
    return _split(_placed(read.json(path)).withColumnRenamed("value", "value_raw"), {"PARSE": F.col("raw").isNotNull(), "NO_KEY": no_key})


def landed_documents(spark: SparkSession, path: str, listed: DataFrame) -> Split:
    """Accepted files (document_id, path, length, content) and rejected ones (document_id, path, length, reason) under a folder.

    document_id is the file's name. A file is accepted if its SHA-256 is the listed one (document_id, sha256); rejected
    are CHANGED, UNLISTED and, of listed ids without a file, ABSENT (path and length null). The hash is taken in the
    scan, and rejects carry no content. Files without a byte are left out by Spark's scan, so a listed one counts as ABSENT.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    hashed = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("document_id"), "path", "length", "content", F.sha2("content", 256).alias("found"))
    known = listed.select("document_id", "sha256")
    joined = hashed.join(known, "document_id", "left")
    accepted = joined.filter("found = sha256").drop("found", "sha256")
    reason = F.when(F.col("found").isNull(), "ABSENT").when(F.col("sha256").isNull(), "UNLISTED").otherwise("CHANGED")
    both = hashed.drop("content").join(known, "document_id", "full_outer")
    rejected = both.filter("not (found <=> sha256)").select("document_id", "path", "length", reason.alias("reason"))
    return accepted, rejected
