"""Decision records: sentences, locators, evidence quotas, variants, completeness, reconciliation and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])[ \t\n\x0b\f\r]+")


def best_sentence(docs: DataFrame, key: str, verbs: dict[str, str], cues: dict[str, int]) -> DataFrame:
    """The action named by the best scored sentence that names one; the earliest on a tie, null if none does."""
    rows = docs.select(key, F.posexplode(sentences(F.col("text"))).alias("at", "sentence"))
    action = reduce(lambda other, kv: F.when(F.col("sentence").rlike(kv[1]), kv[0]).otherwise(other), reversed(verbs.items()), F.lit(None).cast("string"))
    score = reduce(lambda a, b: a + b, [F.when(F.col("sentence").rlike(p), w).otherwise(0) for p, w in cues.items()])
    scored = rows.select(key, "at", action.alias("action"), score.alias("score"))
    best = F.max_by(F.when(F.col("action").isNotNull(), F.col("action")), F.when(F.col("action").isNotNull(), F.struct("score", (-F.col("at")).alias("first"))))
    return scored.groupBy(key).agg(best.alias("action"))


def located(references: DataFrame, docs: DataFrame) -> DataFrame:
    """references (doc_id, locator "paragraph n", excerpt) with the unit's text and whether it holds the excerpt.

    docs: doc_id (once), text. A reference meets its whole text and cuts it there, so texts are not exploded into lines.
    """
    named = references.withColumn("ordinal", F.regexp_extract("locator", r"^paragraph (\d+)$", 1))
    typed = named.withColumn("ordinal", F.when(F.col("ordinal") != "", F.col("ordinal").cast("int")))
    joined = typed.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id", "left")
    unit = F.get(F.split("__text", "\n"), F.col("ordinal") - 1)
    return joined.withColumn("unit", unit).drop("__text").withColumn("found", F.coalesce(F.contains("unit", "excerpt"), F.lit(False)))


def quota_pick(rows: DataFrame, group: str, order: str, least: int, most: int) -> DataFrame:
    """Scored rows first (score > 0, best first) up to `most`; spare rows fill up to `least` where these are too few."""
    tier = F.when(F.col("score") > 0, 0).otherwise(1)
    ranked = rows.withColumn("tier", tier).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("tier", F.col("score").desc(), order)))
    n_scored = F.count_if(F.col("score") > 0).over(Window.partitionBy(group))
    return ranked.withColumn("n_scored", n_scored).filter(F.col("rank") <= F.greatest(F.lit(least), F.least(F.lit(most), F.col("n_scored")))).drop("n_scored", "tier")


def variants(rows: DataFrame, masks: dict[str, list[str]]) -> DataFrame:
    """rows once for each variant, with the variant's masked columns null."""
    each = rows.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in masks])))
    hidden = {c: F.col("variant").isin([v for v, columns in masks.items() if c in columns]) for c in {c for cs in masks.values() for c in cs}}
    return each.withColumns({c: F.when(~h, F.col(c)) for c, h in hidden.items()})


def completeness(rows: DataFrame, group: str, kind: str, required: list[str]) -> DataFrame:
    want = F.array(*[F.lit(k) for k in sorted(required)])
    return rows.groupBy(group).agg(F.sort_array(F.collect_set(kind)).alias("present")).select(group, "present", F.array_except(want, "present").alias("missing"))


def linted(assumptions: DataFrame, series: DataFrame) -> DataFrame:
    """assumptions (monitor_series_id, claim, monitor_operator, threshold_value, monitor_rule_version) with their faults.

    series (series_id, units) is the metadata, an id once.
    """
    known = series.select(F.col("series_id").alias("monitor_series_id"), F.col("units").alias("__units"), F.lit(True).alias("__known"))
    faults = claims.monitor_faults(
        F.col("monitor_series_id"), F.col("claim"), F.col("monitor_operator"), F.col("threshold_value"), F.col("monitor_rule_version"), F.col("__units"), F.col("__known"),
    )
    return assumptions.join(known, "monitor_series_id", "left").withColumn("faults", faults).drop("__units", "__known")


def merged_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Votes (meeting, participant, dissent) under canonical ids; a meeting with both choices is a conflict."""
    mapped = rows.join(aliases.select(F.col("alias").alias("participant"), "canonical"), "participant", "left")
    return mapped.groupBy("meeting", F.coalesce("canonical", "participant").alias("member")).agg(
        F.max("dissent").alias("dissent"), (F.count_distinct("dissent") > 1).alias("conflict")
    )


def reconciled(sources: DataFrame) -> DataFrame:
    """Per meeting, whether all sources (meeting, source, member) name the same members."""
    signed = sources.groupBy("meeting", "source").agg(F.array_join(F.sort_array(F.collect_set("member")), ",").alias("signature"))
    return signed.groupBy("meeting").agg(F.count("*").alias("n_sources"), (F.count_distinct("signature") == 1).alias("agree"))


def readiness(metrics: DataFrame, expected: dict[str, int]) -> DataFrame:
    """metric, actual, expected, ready from a one-row table of metrics."""
    entries = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("actual"), F.lit(v).cast("long").alias("expected")) for k, v in expected.items()]
    return metrics.select(F.explode(F.array(*entries)).alias("m")).select("m.*").withColumn("ready", F.col("actual") == F.col("expected"))
