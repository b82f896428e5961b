import math

import pytest

from tessera.config import Task, TrainingError
from tessera.operators import metrics as M


def _values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_classification_known_values(spark):
    pred = spark.createDataFrame(list(zip("aabb", "abbb")), "actual string, predicted string")
    v = _values(M.classification_metrics(pred))
    assert v["accuracy"] == pytest.approx(0.75)
    assert v["balanced_accuracy"] == pytest.approx(0.75)
    assert v["f1_macro"] == pytest.approx(0.733333, abs=1e-6)
    assert v["f1_weighted"] == pytest.approx(0.733333, abs=1e-6)
    assert v["precision_macro"] == pytest.approx(0.833333, abs=1e-6)
    assert v["recall_macro"] == pytest.approx(0.75)


def test_recall_macro_counts_never_actual_labels(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "c")], "actual string, predicted string")
    v = _values(M.classification_metrics(pred))
    assert v["balanced_accuracy"] == pytest.approx(0.5)
    assert v["recall_macro"] == pytest.approx(0.25)  # c has no support: recall 0


def test_regression_known_values(spark):
    pred = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "actual double, predicted double")
    v = _values(M.regression_metrics(pred))
    assert v["mean_absolute_error"] == pytest.approx(2 / 3, abs=1e-6)
    assert v["root_mean_squared_error"] == pytest.approx(math.sqrt(4 / 3), abs=1e-6)
    assert v["r2"] == pytest.approx(-1.0)


def test_constant_target_r2(spark):
    perfect = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "actual double, predicted double")
    off = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "actual double, predicted double")
    assert _values(M.regression_metrics(perfect))["r2"] == 1.0
    assert _values(M.regression_metrics(off))["r2"] == 0.0


def test_grouped_metrics_and_collect_rules(spark):
    pred = spark.createDataFrame([(1, "a", "a"), (1, "b", "a"), (2, "a", "a"), (2, "b", "b")],
                                 "fold int, actual string, predicted string")
    rows = M.classification_metrics(pred, ["fold"]).filter("metric = 'accuracy'").collect()
    assert {r["fold"]: r["value"] for r in rows} == {1: 0.5, 2: 1.0}
    listed = M.collect_metrics(M.classification_metrics(pred.filter("fold = 2")), 2, Task.CLASSIFICATION)
    assert [m["name"] for m in listed] == sorted(m["name"] for m in listed)
    with pytest.raises(TrainingError):
        M.collect_metrics(M.regression_metrics(
            spark.createDataFrame([(1.0, 1.0)], "actual double, predicted double")), 1, Task.REGRESSION)
