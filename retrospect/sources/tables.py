"""The decision-record tables, read from Parquet; over the driver's tables, the stand-ins that hold their shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, observation_date, realtime_start, realtime_end, value: versions of daily observations (events)."""
    events = table(spark, sf_dir, "events")
    versions = events.groupBy(
        F.col("event_type").alias("series_id"),
        F.date_sub(F.to_date("ts"), F.pmod("event_id", F.lit(4)).cast("int")).alias("observation_date"),
        F.to_date("ts").alias("realtime_start"),
    ).agg(F.max_by("value", "event_id").alias("value"))
    chain = Window.partitionBy("series_id", "observation_date").orderBy("realtime_start")
    end = F.coalesce(F.date_sub(F.lead("realtime_start").over(chain), 1), F.lit(OPEN_END).cast("date"))
    return versions.withColumn("realtime_end", end)


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, cutoff: the day before each Monday of the events' weeks."""
    monday = F.date_trunc("week", F.to_date("ts")).cast("date")
    weeks = table(spark, sf_dir, "events").select(F.date_sub(monday, 1).alias("cutoff")).distinct()
    return weeks.select(F.concat(F.lit("M-"), F.col("cutoff").cast("string")).alias("meeting_id"), "cutoff")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, participant, round, dissent: one row a vote of a round (lineitem)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("meeting"),
        F.col("l_suppkey").alias("participant"),
        F.col("l_linenumber").alias("round"),
        (F.col("l_returnflag") == "R").alias("dissent"),
    )


def member_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting, participant, dissent: rounds of a meeting collapsed to one label a member."""
    return votes(spark, sf_dir).groupBy("meeting", "participant").agg(F.max("dissent").alias("dissent"))


def outcomes(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """meeting, decided_on, action, level and more columns of the orders: one outcome a meeting (orders)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("meeting"),
        F.to_date("o_orderdate").alias("decided_on"),
        F.when(F.col("o_orderstatus") == "F", "CUT").when(F.col("o_orderstatus") == "P", "HIKE").otherwise("HOLD").alias("action"),
        F.round("o_totalprice", 2).alias("level"),
        *more,
    )


def daily_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, day, level: a step level for each series and day (the whole part of a tenth of the first value)."""
    v = vintages(spark, sf_dir)
    return v.groupBy("series_id", F.col("observation_date").alias("day")).agg(
        F.floor(F.min_by("value", "realtime_start") / 10).cast("double").alias("level")
    )


#: The same tables as common table expressions for the SQL twins.
VINTAGES_SQL = """vint AS (
  SELECT *, coalesce(lead(realtime_start) OVER (PARTITION BY series_id, observation_date ORDER BY realtime_start) - 1, DATE '9999-12-31') AS realtime_end
  FROM (SELECT event_type AS series_id, ts::DATE - (event_id % 4)::INTEGER AS observation_date, ts::DATE AS realtime_start,
               arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3))"""
CUTOFFS_SQL = """cut AS (
  SELECT 'M-' || cutoff::VARCHAR AS meeting_id, cutoff
  FROM (SELECT DISTINCT date_trunc('week', ts::DATE)::DATE - 1 AS cutoff FROM events))"""
VOTES_SQL = """votes AS (
  SELECT l_orderkey AS meeting, l_suppkey AS participant, l_linenumber AS round, l_returnflag = 'R' AS dissent FROM lineitem),
mv AS (SELECT meeting, participant, bool_or(dissent) AS dissent FROM votes GROUP BY ALL)"""
OUTCOMES_SQL = """outc AS (
  SELECT o_orderkey AS meeting, o_orderdate::DATE AS decided_on,
         CASE o_orderstatus WHEN 'F' THEN 'CUT' WHEN 'P' THEN 'HIKE' ELSE 'HOLD' END AS action, round(o_totalprice, 2) AS level FROM orders)"""
LEVELS_SQL = f"""{VINTAGES_SQL}, lev AS (
  SELECT series_id, observation_date AS day, floor(arg_min(value, realtime_start) / 10) AS level FROM vint GROUP BY 1, 2)"""
