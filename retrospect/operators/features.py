"""Feature rows of series as they were visible at a cutoff, and first breaches of a growth by first releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_rows(seen: DataFrame, levels: DataFrame, spec: dict[str, tuple[str, ...]], ago: Column) -> DataFrame:
    """meeting_id and one column a feature, for all meetings in one job.

    seen: meeting_id, series_id, observation_date, value (what each cutoff shows). levels: meeting_id, level (the policy
    rate in force). spec: feature: ("level", series), ("change", series), ("growth", series), ("spread", series, series)
    or ("rate",). Change and growth (in percent) are against the same series on the day `ago` of observation_date, null
    where that day is missing or its value is 0.
    """
    last = seen.groupBy("meeting_id", "series_id").agg(F.max_by(F.struct("observation_date", "value"), "observation_date").alias("v"))
    newest = last.select("meeting_id", "series_id", F.col("v.observation_date").alias("observation_date"), F.col("v.value").alias("value"))
    past = seen.select("meeting_id", "series_id", F.col("observation_date").alias("ago_date"), F.col("value").alias("before"))
    both = newest.withColumn("ago_date", ago).join(past, ["meeting_id", "series_id", "ago_date"], "left")
    pick = lambda series, name: F.max(F.when(F.col("series_id") == series, F.col(name)))
    made = []
    for feature, (kind, *series) in spec.items():
        if kind == "level":
            made.append(pick(series[0], "value").alias(feature))
        elif kind == "change":
            made.append((pick(series[0], "value") - pick(series[0], "before")).alias(feature))
        elif kind == "growth":
            made.append(((F.try_divide(pick(series[0], "value"), pick(series[0], "before")) - 1) * 100).alias(feature))
        elif kind == "spread":
            made.append((pick(series[0], "value") - pick(series[1], "value")).alias(feature))
    rates = [F.col("level").alias(feature) for feature, (kind, *_) in spec.items() if kind == "rate"]
    rows = both.groupBy("meeting_id").agg(*made).join(levels.select("meeting_id", "level"), "meeting_id", "left")
    names = {feature: (rates.pop(0) if kind == "rate" else F.col(feature)) for feature, (kind, *_) in spec.items()}
    return rows.select("meeting_id", *names.values())


def feature_evidence(as_of: DataFrame) -> DataFrame:
    """meeting_id, series_id, observation_date, realtime_start, value: the visible version behind each feature."""
    return as_of.select("meeting_id", "series_id", "observation_date", "realtime_start", "value")


def first_growth_breach(versions: DataFrame, claims: DataFrame, ago: Column) -> DataFrame:
    """claims (claim, series_id, after, threshold) with the first release whose growth over the day `ago` passes the threshold.

    A release is the first version of an observation that comes after the claim's date; earlier ones are left out before
    the first is taken, so a revision can be one. The value before is the one in force on the release's day (the newest
    start). The first by release day and observation counts; claims without a breach keep nulls.
    """
    later = versions.filter(F.col("value").isNotNull()).join(claims, "series_id").filter(F.col("realtime_start") > F.col("after"))
    first = later.groupBy("claim", "series_id", "threshold", "observation_date").agg(F.min(F.struct("realtime_start", "value")).alias("v"))
    released = first.select("claim", "series_id", "threshold", "observation_date", F.col("v.realtime_start").alias("released_on"), F.col("v.value").alias("value"))
    past = versions.select("series_id", F.col("observation_date").alias("ago_date"), F.col("realtime_start").alias("s"), F.col("realtime_end").alias("e"), F.col("value").alias("before"))
    found = released.withColumn("ago_date", ago).join(past, ["series_id", "ago_date"]).filter(F.col("released_on").between(F.col("s"), F.col("e")))
    keys = ["claim", "threshold", "observation_date", "released_on", "value"]
    shown = found.groupBy(*keys).agg(F.max_by("before", "s").alias("before"))
    over = shown.withColumn("growth", (F.try_divide(F.col("value"), F.col("before")) - 1) * 100).filter(F.col("growth") > F.col("threshold"))
    best = over.groupBy("claim").agg(F.min(F.struct("released_on", "observation_date", "growth")).alias("b"))
    return claims.join(best, "claim", "left").select("claim", F.col("b.released_on").alias("released_on"), F.col("b.observation_date").alias("observation_date"), F.col("b.growth").alias("growth"))


def lag_records(claims: DataFrame, breaches: DataFrame, flips: DataFrame, responses: DataFrame) -> DataFrame:
    """claim, recognition_days, action_days, response_days, status from breaches (claim, released_on), flips (claim, flip_at), responses (claim, response_at)."""
    joined = claims.select("claim").join(breaches.select("claim", "released_on"), "claim", "left").join(flips.select("claim", "flip_at"), "claim", "left").join(responses.select("claim", "response_at"), "claim", "left")
    days = lambda a, b: F.when(F.col(b) >= F.col(a), F.date_diff(b, a))
    status = F.when(F.col("released_on").isNull(), "NO_BREACH").when(F.col("flip_at").isNull(), "NO_STATEMENT_FLIP_AS_OF").when(F.col("response_at").isNull(), "RIGHT_CENSORED_RATE_ONLY").otherwise("OBSERVED")
    return joined.select("claim", days("released_on", "flip_at").alias("recognition_days"), days("flip_at", "response_at").alias("action_days"), days("released_on", "response_at").alias("response_days"), status.alias("status"))
