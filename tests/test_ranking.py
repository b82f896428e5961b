import pytest
from pyspark.sql import functions as F

from tessera.config import ComparisonError
from tessera.operators import ranking as RK


def test_cv_stability_ranking_tie_breaks(spark):
    rows = []
    for est, vals in (("dummy-classifier", (.5, .5, .5)), ("logistic-regression", (.5, .5, .5)),
                      ("random-forest-classifier", (.4, .5, .6))):
        rows += [(est, i + 1, "balanced_accuracy", v, True) for i, v in enumerate(vals)]
    per_fold = spark.createDataFrame(rows, "estimator string, fold int, metric string, value double, "
                                           "higher_is_better boolean")
    summ = RK.fold_summaries(per_fold)
    ranks = {r["estimator"]: r["rank"] for r in RK.stability_rank(summ, "balanced_accuracy").collect()}
    assert ranks == {"dummy-classifier": 1, "logistic-regression": 2, "random-forest-classifier": 3}
    forest = summ.filter("estimator = 'random-forest-classifier'").first()
    assert forest["fold_values"] == [0.4, 0.5, 0.6]
    assert forest["standard_deviation"] == pytest.approx(0.08165, abs=1e-5)
    assert RK.evidence_audit(per_fold, summ).count() == 0


def runs_frame(spark, seeds=(42, 42), statuses=("succeeded", "succeeded")):
    rows = [(f"run-{i}", "est-" + "ba"[i], st, "classification", "fp", "t", 0.2, s, True, "digest")
            for i, (s, st) in enumerate(zip(seeds, statuses))]
    return spark.createDataFrame(rows, "run_id string, estimator string, status string, task string, "
                                       "dataset_sha256 string, target string, validation_fraction double, "
                                       "random_seed int, stratified boolean, partition_sha256 string")


def test_compare_runs_ties_by_run_id_and_contract(spark):
    metrics = spark.createDataFrame([("run-0", "accuracy", 0.8, True), ("run-1", "accuracy", 0.8, True)],
                                    "run_id string, metric string, value double, higher_is_better boolean")
    ranked = RK.compare_runs(runs_frame(spark), metrics, "accuracy").collect()
    assert [r["run_id"] for r in ranked] == ["run-0", "run-1"]
    with pytest.raises(ComparisonError, match="same task"):
        RK.compare_runs(runs_frame(spark, seeds=(1, 2)), metrics, "accuracy")
    with pytest.raises(ComparisonError, match="successful"):
        RK.compare_runs(runs_frame(spark, statuses=("succeeded", "failed")), metrics, "accuracy")
    mixed = metrics.withColumn("higher_is_better", F.col("run_id") == "run-0")
    with pytest.raises(ComparisonError, match="direction"):
        RK.compare_runs(runs_frame(spark), mixed, "accuracy")


def test_leaderboard_rank_status_and_audit(spark):
    entries = spark.createDataFrame(
        [("b", "r1", "succeeded", 0.7, True), ("a", "r2", "succeeded", 0.7, True), ("c", "r3", "failed", None, True)],
        "estimator string, run_id string, status string, value double, higher_is_better boolean")
    board = RK.leaderboard_rank(entries)
    ranks = {r["estimator"]: r["rank"] for r in board.collect()}
    assert ranks == {"a": 1, "b": 2, "c": None}
    assert RK.status_of(entries).first()["status"] == "partial"
    assert RK.leaderboard_audit(board).count() == 0
    tampered = board.withColumn("rank", F.when(F.col("estimator") == "a", 2).otherwise(F.col("rank")))
    assert RK.leaderboard_audit(tampered).count() >= 1
