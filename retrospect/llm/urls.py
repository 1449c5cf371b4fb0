"""URL filters: rules first, then the ratio of two character language models.

Accepted and rejected URLs (those that a rule decides) train one smoothed variable-order Markov model each: counts of
4-character grams give the counts of all shorter contexts, and Witten-Bell smoothing backs an unseen context off to
the next shorter one. A URL's score is the mean over its characters of the log-likelihood difference. The threshold is
calibrated on held-out labelled URLs (every fifth id) for the best balanced accuracy. URLs that no rule fits are allowed if their score
reaches the threshold.

Characters are folded to at most 32 symbols, so there are at most 33^4 grams whatever the input; the table of gram
scores is broadcast up to `broadcast_grams` of them (some 50 MB), beyond that the join is a shuffle's. Grams are counted
with map-side aggregation. Everything is DataFrame expressions. Other columns of pages are ignored, whatever their names.

Null URLs and URLs without :// have an empty host and path and no rule; without labelled URLs of both kinds every
score is 0 and every URL is allowed; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4
SYMBOLS = 33.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        applies = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits = F.when(applies, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def grams(host: Column, path: Column) -> Column:
    """The 4-character grams of a folded host and path, one for each character and the end."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0"), "[^a-z0./_-]", "~")
    chars = F.split(F.concat(F.lit("^" * (ORDER - 1)), folded, F.lit("$")), "")
    tail = F.slice(chars, ORDER, F.size(chars) - (ORDER - 1))
    return F.transform(tail, lambda c, i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2), c))


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram, score from gram, accepted, rejected: the log of the ratio of the two models' probabilities."""
    lower = None
    for order in range(1, ORDER + 1):
        own = counts.groupBy(F.substring("gram", ORDER - order + 1, order).alias("g")).agg(
            F.sum("accepted").alias("a"), F.sum("rejected").alias("r")
        )
        context = Window.partitionBy(F.substring("g", 1, order - 1))
        parts = []
        for side in ("a", "r"):
            parts += [
                F.sum(side).over(context).alias(f"n_{side}"),
                F.count_if(F.col(side) > 0).over(context).alias(f"t_{side}"),
            ]
        own = own.select("g", "a", "r", *parts)
        if lower is None:
            own = own.withColumns({"b_a": F.lit(1.0 / SYMBOLS), "b_r": F.lit(1.0 / SYMBOLS)})
        else:
            own = own.withColumn("h", F.substring("g", 2, order - 1)).join(lower, "h")
        smoothed = {
            side: F.when(
                F.col(f"n_{side}") > 0,
                (F.col(side) + F.col(f"t_{side}") * F.col(f"b_{side}")) / (F.col(f"n_{side}") + F.col(f"t_{side}")),
            ).otherwise(F.col(f"b_{side}"))
            for side in ("a", "r")
        }
        lower = own.select(F.col("g").alias("h"), smoothed["a"].alias("b_a"), smoothed["r"].alias("b_r"))
    return lower.select(F.col("h").alias("gram"), (F.log("b_a") - F.log("b_r")).alias("score"))


def calibrated(scores: DataFrame, step: float = 0.01) -> DataFrame:
    """One row, threshold: the multiple of step with the best balanced accuracy over scores (label, score)."""
    bins = scores.groupBy(F.floor(F.col("score") / step).cast("long").alias("bin")).agg(
        F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("r")
    )
    order = Window.orderBy("bin")
    at_least = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rates = bins.select(
        "bin",
        (F.sum("a").over(at_least) / F.nullif(F.sum("a").over(whole), F.lit(0))).alias("kept"),
        (F.coalesce(F.sum("r").over(below), F.lit(0)) / F.nullif(F.sum("r").over(whole), F.lit(0))).alias("stopped"),
    )
    best = F.min_by("bin", F.struct(-F.round(F.col("kept") + F.col("stopped"), 9), F.abs("bin"), "bin"))
    return rates.filter("kept is not null and stopped is not null").agg(F.coalesce(best * F.lit(step), F.lit(0.0)).alias("threshold"))


def judge_urls(pages: DataFrame, rules=RULES, holdout: int = 5, broadcast_grams: int = 400_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for every row of pages."""
    host, path = split_url(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    rows = staged(
        ruled.select(
            F.monotonically_increasing_id().alias("row"),
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.col("fit.verdict").alias("label"),
            F.coalesce(F.pmod(F.col("page_id"), F.lit(holdout)) == 0, F.lit(False)).alias("held_out"),
        ),
        "urls",
    )
    positions = rows.select("row", "label", "held_out", F.explode(grams(F.col("host"), F.col("path"))).alias("gram"))
    trains = ~F.col("held_out")
    counts = positions.groupBy("gram").agg(
        F.count_if(trains & (F.col("label") == "allow")).alias("accepted"), F.count_if(trains & (F.col("label") == "block")).alias("rejected")
    )
    model = staged(gram_scores(staged(counts, "gram-counts")), "gram-scores")
    if model.count() <= broadcast_grams:
        model = F.broadcast(model)
    scored = staged(
        positions.join(model, "gram").groupBy("row").agg(F.round(F.avg("score"), 9).alias("score")), "url-scores"
    )
    judged = rows.join(scored, "row")
    threshold = calibrated(judged.filter("held_out and label is not null")).first()["threshold"]  # one number
    verdict = F.coalesce("label", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))
