"""Baselines on literal votes: the threshold comes from training rows, ties go by the stated order."""

from pyspark.sql import functions as F
from retrospect.operators import evaluation as e

NAMES = "test boolean, dissent boolean, previous_dissent boolean, prior_rate double"


def _by_name(rows):
    return {r.baseline: r for r in rows}


def test_threshold_is_of_the_training_rows(spark):
    training = [(False, True, False, 0.6), (False, False, False, 0.4), (False, False, False, None)]
    test = [(True, True, True, 0.3), (True, False, True, 0.7), (True, True, False, 0.6)]  # 0.3 would do better here
    found = _by_name(e.vote_baselines(spark.createDataFrame(training + test, NAMES), F.col("test"), [0.3, 0.5, 0.6, 0.8]).collect())
    assert [found[b].threshold for b in e.BASELINES] == [None, None, 0.6]
    assert [(found[b].tp, found[b].fp, found[b].fn, found[b].tn) for b in e.BASELINES] == [(0, 0, 2, 1), (1, 1, 1, 0), (1, 1, 1, 0)]
    assert [found[b].is_reference for b in e.BASELINES] == [False, True, False]  # a tie with the rate baseline


def test_sides_without_rows(spark):
    rows = [(True, True, True, 0.3), (True, False, None, None)]
    found = _by_name(e.vote_baselines(spark.createDataFrame(rows, NAMES), F.col("test"), [0.1]).collect())
    assert (found["prior_dissent_rate"].threshold, found["prior_dissent_rate"].tp) == (None, 0)
    assert found["previous_vote"].is_reference
    assert e.vote_baselines(spark.createDataFrame([(False, True, True, 0.3)], NAMES), F.col("test"), [0.1]).count() == 0


def test_majority_ties_go_by_class(spark):
    rows = [(False, "HIKE", None), (False, "CUT", "HIKE"), (True, "CUT", None), (True, "HOLD", "HOLD")]
    frame = spark.createDataFrame(rows, "test boolean, actual string, persisted string")
    found = {(r.predictor, r["class"]): (r.support, r.precision, r.recall) for r in e.frozen_split_report(frame, F.col("test"), ["CUT", "HOLD", "HIKE"]).collect()}
    assert found[("majority", "CUT")] == (1, 0.5, 1.0)
    assert found[("majority", "HOLD")] == (1, 0.0, 0.0)
    assert found[("persistence", "HOLD")] == (1, 1.0, 1.0)
    assert found[("persistence", "CUT")] == (1, 0.0, 0.0)
