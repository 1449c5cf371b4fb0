"""Classification reports, baselines, threshold choice, ensembles, gates and the ordered logit fit."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import as_of_join, first_after


def class_report(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """class, support, precision, recall, f1 from rows (actual, predicted); 0 where undefined."""
    counts = pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    rows = counts.select("*", each).groupBy("class").agg(
        F.sum(F.when(F.col("actual") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("predicted") == F.col("class"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when((F.col("actual") == F.col("class")) & (F.col("predicted") == F.col("class")), F.col("n")).otherwise(0)).alias("hit"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select(
        "class", "support", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
    )


def binary_counts(actual: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"),
    ]


def binary_report(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn, tn) with precision, recall, specificity, balanced accuracy, F1 and Matthews correlation."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.withColumns({
        "base_rate": ratio(tp + fn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": recall, "specificity": specificity,
        "balanced": (recall + specificity) / 2, "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })


def threshold_trace(history: DataFrame, thresholds: list[float]) -> DataFrame:
    """Binary report of `prior_rate >= threshold` for each threshold, in one pass over history (dissent, prior_rate)."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    said = F.coalesce(F.col("prior_rate") >= F.col("threshold"), F.lit(False))
    rates = history.groupBy("dissent", "prior_rate").agg(F.count("*").alias("n")).select("*", grid)
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    a = F.col("dissent")
    counts = rates.groupBy("threshold").agg(n(a & said).alias("tp"), n(~a & said).alias("fp"), n(a & ~said).alias("fn"), n(~a & ~said).alias("tn"))
    return binary_report(counts)


def best_threshold(trace: DataFrame) -> DataFrame:
    return trace.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", "balanced", "precision", "threshold")).alias("best")).select("best.*")


BASELINES = ("all_for", "previous_vote", "prior_dissent_rate")


def vote_baselines(history: DataFrame, in_test: Column, thresholds: list[float]) -> DataFrame:
    """baseline, threshold, its binary report on the test rows and whether it is the one that a model has to beat.

    history has dissent, previous_dissent and prior_rate. The threshold of prior_dissent_rate is chosen on training rows
    only, by F1, balanced accuracy, precision, then the higher one; without training rows it is null and that baseline
    never expects a dissent. The reference is the best by F1, balanced accuracy and precision, ties to the order of
    BASELINES. Without test rows there is no result.
    """
    chosen = best_threshold(threshold_trace(history.filter(~in_test), thresholds)).select(F.col("threshold").alias("chosen"))  # one row
    cases = history.filter(in_test).groupBy("dissent", "previous_dissent", "prior_rate").agg(F.count("*").alias("n"))
    said = (F.lit(False), F.col("previous_dissent"), F.col("prior_rate") >= F.col("chosen"))
    each = [F.struct(F.lit(i).alias("place"), F.lit(b).alias("baseline"), F.coalesce(x, F.lit(False)).alias("said")) for i, (b, x) in enumerate(zip(BASELINES, said, strict=True))]
    rows = cases.crossJoin(F.broadcast(chosen)).select("dissent", "n", "chosen", F.explode(F.array(*each)).alias("b")).select("dissent", "n", "chosen", "b.*")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    a, x = F.col("dissent"), F.col("said")
    counts = rows.groupBy("place", "baseline", F.when(F.col("place") == 2, F.col("chosen")).alias("threshold")).agg(
        n(a & x).alias("tp"), n(~a & x).alias("fp"), n(a & ~x).alias("fn"), n(~a & ~x).alias("tn")
    )
    best = Window.orderBy(F.col("f1").desc(), F.col("balanced").desc(), F.col("precision").desc(), "place")  # three rows
    return binary_report(counts).withColumn("is_reference", F.row_number().over(best) == 1).drop("place")


def frozen_split_report(cases: DataFrame, in_test: Column, classes: list[str]) -> DataFrame:
    """predictor (majority, persistence), class, support, precision, recall, f1 on the test rows of cases (actual, persisted).

    The majority is the most frequent action of the training rows, ties to the order of the classes; without training
    rows it is null and hits nothing. A null persisted action hits nothing.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("actual"))
    sizes = cases.filter(~in_test).groupBy("actual").agg(F.count("*").alias("n"))
    majority = sizes.agg(F.max_by("actual", F.struct(F.col("n"), -place)).alias("majority"))  # one row
    test = cases.filter(in_test).groupBy("actual", "persisted").agg(F.count("*").alias("n")).crossJoin(F.broadcast(majority))
    each = F.array(F.struct(F.lit("majority").alias("predictor"), F.col("majority").alias("predicted")), F.struct(F.lit("persistence").alias("predictor"), F.col("persisted").alias("predicted")))
    said = test.select("actual", "n", F.explode(each).alias("p"))
    rows = said.select("actual", "n", "p.*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    own, told = F.col("actual") == F.col("class"), F.coalesce(F.col("predicted") == F.col("class"), F.lit(False))
    counts = rows.groupBy("predictor", "class").agg(n(own).alias("support"), n(told).alias("said"), n(own & told).alias("hit"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return counts.select(
        "predictor", "class", "support", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
    )


def ensemble(predictions: DataFrame, need: int, fallback: Column) -> DataFrame:
    """case, choice: the class that at least `need` predictions (case, action) name, else the fallback."""
    counts = predictions.groupBy("case", "action").agg(F.count("*").alias("n"))
    top = counts.groupBy("case").agg(F.min(F.struct((-F.col("n")).alias("m"), "action")).alias("t"))
    return top.select("case", F.when(-F.col("t.m") >= need, F.col("t.action")).otherwise(fallback).alias("choice"))


def fit_ordered_logit(rows: DataFrame, features: list[str], label: str, steps: int = 40) -> tuple[np.ndarray, list[float]]:
    """Coefficients, first cut and log-width of a three-class ordered logit; log-likelihoods of the steps.

    rows: standardised features and a label 0, 1, 2. One pass over the data a step gives the gradient and the
    (outer-product) curvature as aggregates; only these small sums reach the driver.
    """
    k = len(features)
    theta = np.zeros(k + 2)
    theta[k], theta[k + 1] = -1.0, math.log(2.0)
    trace: list[float] = []
    damping = 1e-3
    best = None
    for _ in range(steps):
        score = sum((F.col(f) * float(w) for f, w in zip(features, theta, strict=False)), F.lit(0.0))
        low, width = float(theta[k]), math.exp(float(theta[k + 1]))
        sigma = lambda z: 1 / (1 + F.exp(-z))
        g1, g2 = sigma(F.lit(low) - score), sigma(F.lit(low + width) - score)
        d1, d2 = g1 * (1 - g1), g2 * (1 - g2)
        p = F.when(F.col(label) == 0, g1).when(F.col(label) == 1, g2 - g1).otherwise(1 - g2)
        by_low = F.when(F.col(label) == 0, d1).when(F.col(label) == 1, d2 - d1).otherwise(-d2) / p
        by_width = F.when(F.col(label) == 0, 0.0).when(F.col(label) == 1, d2 * width).otherwise(-d2 * width) / p
        parts = rows.select(F.log(p).alias("ll"), *[(-by_low * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)], by_low.alias(f"g{k}"), by_width.alias(f"g{k + 1}"))
        size = k + 2
        sums = parts.agg(F.sum("ll").alias("ll"), *[F.sum(f"g{i}").alias(f"s{i}") for i in range(size)],
                         *[F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"h{i}_{j}") for i in range(size) for j in range(i + 1)]).first()
        if best is not None and sums["ll"] < best[0]:
            damping *= 10
            theta = best[1] + np.linalg.solve(best[3] + damping * np.diag(np.diag(best[3])), best[2])
            continue
        gradient = np.array([sums[f"s{i}"] for i in range(size)])
        curvature = np.array([[sums[f"h{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)])
        trace.append(sums["ll"])
        best = (sums["ll"], theta.copy(), gradient, curvature)
        damping = max(damping / 10, 1e-9)
        if np.abs(gradient).max() < 1e-6 or (len(trace) > 1 and trace[-1] - trace[-2] < 1e-9):
            break
        theta = theta + np.linalg.solve(curvature + damping * np.diag(np.diag(curvature)), gradient)
    return best[1], trace


def rate_outcomes(meetings: DataFrame, versions: DataFrame, switch: str, target: str, lower: str, upper: str) -> DataFrame:
    """What each meeting (meeting_id, cutoff, ended) did to the rate, from versions of a target and, from the day `switch` on, a range.

    A meeting that is cut off and ends before the switch compares the target visible at the cutoff with the first one
    after its end; one that ends on or after it compares that target with the middle of the first range on or after its
    end; one cut off later compares the middle of the range visible at the cutoff with that of the first range after its
    end. A range is a day with a lower and an upper value, each in its newest version. Columns: meeting_id, action,
    pre_target, pre_lower, pre_upper, post_target, post_lower, post_upper, effective. Where a value isn't known, action is
    null; values within 1e-9 are a HOLD.
    """
    known = versions.filter(F.col("value").isNotNull() & F.col("series_id").isin(target, lower, upper))
    of = lambda name: F.max(F.when(F.col("series_id") == name, F.col("value")))
    before = as_of_join(known, meetings.select("meeting_id", "cutoff")).groupBy("meeting_id").agg(of(target).alias("seen_target"), of(lower).alias("seen_lower"), of(upper).alias("seen_upper"))
    newest = known.filter(F.col("series_id") != target).groupBy("series_id", "observation_date").agg(F.max_by("value", "realtime_start").alias("value"))
    days = newest.groupBy("observation_date").agg(of(lower).alias("lower"), of(upper).alias("upper")).filter("lower is not null and upper is not null")
    ranges = days.select(F.lit("range").alias("series_id"), "observation_date", F.col("observation_date").alias("realtime_start"), F.struct("lower", "upper").alias("value"))

    old, crossing = F.col("cutoff") < F.lit(switch).cast("date"), F.col("ended") >= F.lit(switch).cast("date")
    points = meetings.select("meeting_id", "cutoff", F.col("ended").alias("at"), "ended")
    single = first_after(known.filter(F.col("series_id") == target), points.filter(old & ~crossing).select("meeting_id", "at"))
    on_day = first_after(ranges, points.filter(old & crossing).select("meeting_id", "at"), inclusive=True)
    later = first_after(ranges, points.filter(~old).select("meeting_id", "at"))
    pair = on_day.unionByName(later).select("meeting_id", F.col("value.lower").alias("post_lower"), F.col("value.upper").alias("post_upper"), F.col("observation_date").alias("range_day"))
    one = single.select("meeting_id", F.col("value").alias("post_target"), F.col("observation_date").alias("target_day"))
    rows = meetings.join(before, "meeting_id", "left").join(one, "meeting_id", "left").join(pair, "meeting_id", "left")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    change = F.coalesce("post_target", middle("post_lower", "post_upper")) - F.when(old, F.col("seen_target")).otherwise(middle("seen_lower", "seen_upper"))
    action = F.when(change > 1e-9, "HIKE").when(change < -1e-9, "CUT").when(change.isNotNull(), "HOLD")
    return rows.select(
        "meeting_id", action.alias("action"), F.when(old, F.col("seen_target")).alias("pre_target"), F.when(~old, F.col("seen_lower")).alias("pre_lower"), F.when(~old, F.col("seen_upper")).alias("pre_upper"),
        "post_target", "post_lower", "post_upper", F.coalesce("target_day", "range_day").alias("effective"),
    )
