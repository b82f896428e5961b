import os

import pytest
from pyspark.sql import functions as F

from tessera.config import ConfigurationError, FoldConfig, Task, TrainingFailedError
from tessera.operators import estimators as E
from tessera.plans import benchmark as B
from tessera.plans import crossval as CV
from tessera.plans import final as G
from tessera.plans import artifacts as A
from tessera.plans.registry import Registry
from tessera.plans.scoring import number_rows, predict_frame
from tessera.plans.train import TrainingConfig, train


def cls_frame(spark, n=60):
    return spark.createDataFrame(
        [(f"r{i:03d}", None if i in (4, 17) else 20 + i, "abc"[i % 3], "yes" if i % 5 in (0, 1) else "no")
         for i in range(n)], "row_id string, age int, region string, target string")


def test_train_records_success_and_metrics(spark, scratch):
    reg = Registry(spark, scratch)
    res = train(cls_frame(spark), TrainingConfig(Task.CLASSIFICATION, E.LOGISTIC_REGRESSION),
                target="target", key=["row_id"], registry=reg)
    rec = reg.read("runs", res.record["run_id"])
    assert rec["status"] == "succeeded" and len(rec["metrics"]) == 6
    assert [m["name"] for m in rec["metrics"]] == sorted(m["name"] for m in rec["metrics"])
    assert rec["split"]["validation_rows"] == 12
    assert res.predictions.count() == 12
    with pytest.raises(Exception):
        reg.write("runs", res.record)  # create-only


def test_regression_run_and_task_mismatch(spark):
    df = spark.createDataFrame([(i, i / 2, "ab"[i % 2], 3 * i + 2) for i in range(40)],
                               "row_id int, value double, group string, target int")
    res = train(df, TrainingConfig(Task.REGRESSION, E.RIDGE_REGRESSION), target="target", key=["row_id"])
    r2 = next(m["value"] for m in res.record["metrics"] if m["name"] == "r2")
    assert r2 > 0.99
    with pytest.raises(ConfigurationError):
        train(df, TrainingConfig(Task.REGRESSION, E.DUMMY_CLASSIFIER), target="target", key=["row_id"])


def test_infinite_feature_is_a_recorded_failure(spark, scratch):
    reg = Registry(spark, scratch)
    df = spark.createDataFrame([(i, float("inf") if i == 3 else float(i), "ab"[i % 2]) for i in range(10)],
                               "k int, value double, target string")
    with pytest.raises(TrainingFailedError) as info:
        train(df, TrainingConfig(Task.CLASSIFICATION, E.DUMMY_CLASSIFIER), target="target", key=["k"],
              registry=reg)
    rec = reg.read("runs", info.value.run_id)
    assert rec["status"] == "failed" and rec["metrics"] is None
    assert "infinite" in rec["failure"]["message"]


def test_benchmark_cv_final_and_scoring(spark, scratch):
    reg = Registry(spark, scratch)
    df = spark.createDataFrame([(i, "abc"[i % 3], "yes" if i >= 30 else "no") for i in range(60)],
                               "amount int, region string, target string")
    bench = B.benchmark(df, B.BenchmarkConfig(estimators=(E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION)),
                        target="target", key=["amount"], registry=reg)
    assert bench.record["status"] == "succeeded" and bench.winner == E.LOGISTIC_REGRESSION
    cfg = CV.CrossValidationConfig(estimators=(E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION),
                                   folds=FoldConfig(3, 42))
    cv = CV.cross_validate(df, cfg, target="target", key=["amount"], registry=reg)
    assert cv.winner == E.LOGISTIC_REGRESSION
    assert len({f["partition_sha256"] for f in cv.record["folds"]}) == 3
    dummy = next(e for e in cv.record["entries"] if e["estimator"] == E.DUMMY_CLASSIFIER)
    assert dummy["primary_metric_mean"] == 0.5
    stored = reg.read("cv_benchmarks", cv.record["benchmark_id"])
    final = G.fit_selected_model(df, stored, target="target", key=["amount"], registry=reg)
    assert final.record["fit_scope"] == "all_rows" and final.record["training_rows"] == 60
    artifact = A.load(reg, final.record["final_model_id"])
    assert artifact.feature_names == ["amount", "region"]
    new = spark.createDataFrame([(70, "central"), (5, "a")], "amount int, region string")
    preds = {r["amount"]: r["prediction"] for r in predict_frame(artifact, new, key=["amount"]).collect()}
    assert preds == {70: "yes", 5: "no"}
    numbered = number_rows(predict_frame(artifact, new, key=["amount"]), ["amount"]).collect()
    assert sorted((r["amount"], r["row_number"]) for r in numbered) == [(5, 1), (70, 2)]
    assert A.lineage_violations(spark, reg).count() == 0
    altered = df.withColumn("amount", F.col("amount") + 1)
    with pytest.raises(Exception, match="does not match"):
        G.fit_selected_model(altered, stored, target="target", key=["amount"], registry=reg)


def test_cv_is_reproducible_and_parameters_recorded(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], "yes" if i % 4 in (0, 1) else "no") for i in range(60)],
                               "value int, segment string, target string")
    cfg = CV.CrossValidationConfig(estimators=(E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION), folds=FoldConfig(3, 7))
    a = CV.cross_validate(df, cfg, target="target", key=["value"]).record
    b = CV.cross_validate(df, cfg, target="target", key=["value"]).record
    assert a["fold_plan_sha256"] == b["fold_plan_sha256"]
    assert [(e["estimator"], e["rank"], e["primary_metric_mean"]) for e in a["entries"]] == \
        [(e["estimator"], e["rank"], e["primary_metric_mean"]) for e in b["entries"]]
    logistic = next(e for e in a["entries"] if e["estimator"] == E.LOGISTIC_REGRESSION)
    assert {"name": "C", "value": "1.0"} in logistic["parameters"]
    tampered = dict(a, entries=[dict(e, parameters=[{"name": "C", "value": "9"}]) for e in a["entries"]])
    with pytest.raises(Exception, match="parameters changed"):
        G.fit_selected_model(df, tampered, target="target", key=["value"])


def test_keyless_table_gets_content_key(spark):
    from tessera.functions.frames import ROW_KEY, with_row_key

    rows = [(i % 4, "ab"[i % 2]) for i in range(40)]  # many identical rows
    df = spark.createDataFrame(rows, "x int, target string").repartition(3)
    keyed = with_row_key(df)
    assert keyed.select(ROW_KEY).distinct().count() == 40
    assert sorted(map(tuple, keyed.drop(ROW_KEY).collect())) == sorted(rows)
    res = train(df, TrainingConfig(Task.CLASSIFICATION, E.LOGISTIC_REGRESSION), target="target")
    assert res.record["status"] == "succeeded" and res.record["split"]["validation_rows"] == 8
    assert res.record["split"]["feature_count"] == 1
    assert res.stats.schema.all_features == ("x",)


def test_keyless_cross_validation(spark):
    df = spark.createDataFrame([(i % 6, "abc"[i % 3]) for i in range(45)], "x int, target string")
    cfg = CV.CrossValidationConfig(estimators=(E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION), folds=FoldConfig(3, 2))
    rec = CV.cross_validate(df, cfg, target="target").record
    assert sum(f["validation_rows"] for f in rec["folds"]) == 45
    assert rec["dataset"]["column_count"] == 2 and rec["status"] == "succeeded"


def test_refit_uses_the_recorded_configuration(spark, scratch):
    """Non-default imputation, scaling and roles reach the all-row refit."""
    from tessera.config import FeatureOverrides, ForestConfig, Imputation, PreprocessingConfig
    from tessera.operators import features as FE

    rows = [(i, float(i % 7) if i % 5 else None, "abc"[i % 3], "yes" if i % 4 in (0, 1) else "no") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, value double, segment string, target string")
    prep = PreprocessingConfig(Imputation.MEAN, False, "none")
    cfg = CV.CrossValidationConfig(estimators=(E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION), folds=FoldConfig(3, 7),
                                   preprocessing=prep, overrides=FeatureOverrides(categorical=("k",)),
                                   forest=ForestConfig(trees=5, max_depth=3))
    reg = Registry(spark, os.path.join(scratch, "reg"))
    cv = CV.cross_validate(df, cfg, target="target", key=["k"], registry=reg)
    stored = reg.read("cv_benchmarks", cv.record["benchmark_id"])
    final = G.fit_selected_model(df, stored, target="target", key=["k"], registry=reg)
    direct = FE.fit_feature_stats(df, FE.infer_feature_schema(df, ["k", "value", "segment"], cfg.overrides), prep)
    got = final.stats
    assert (got.fill, got.center, got.scale, got.categories) == \
        (direct.fill, direct.center, direct.scale, direct.categories)
    assert got.schema.categorical == ("k", "segment") and got.config == prep
    kept = reg.read("final_models", final.record["final_model_id"])
    assert kept["model_path"] and kept["configuration"]["forest"]["trees"] == 5


def test_small_values_keep_their_digits(spark):
    from tessera.operators import metrics as M
    from tessera.operators import profile as P

    df = spark.createDataFrame([(1e-8, 1e-8), (3e-8, 2e-8)], "actual double, predicted double")
    value = {r["metric"]: r["value"] for r in M.regression_metrics(df).collect()}
    assert 0 < value["mae"] < 1e-8 if "mae" in value else all(v != 0 for v in value.values())
    row = P.column_profiles(df).filter("column_name = 'actual'").first()
    assert row["minimum"] == 1e-8 and abs(row["mean"] - 2e-8) < 1e-20


def test_wide_ridge_equals_the_closed_form(spark):
    """More encoded columns than the normal solver takes."""
    from tessera.config import Task

    n = 5000
    df = spark.range(2 * n).selectExpr(
        "id", "concat('c', id % 5000) as c", "cast((id % 5000) % 17 + (id div 5000) as double) as y")
    from tessera.operators import features as FE
    stats = FE.fit_feature_stats(df, FE.infer_feature_schema(df, ["c"]))
    model = E.fit_estimator(df, stats, target="y", estimator=E.RIDGE_REGRESSION, task=Task.REGRESSION, seed=1, key=["id"])
    got = {r["id"]: r["prediction"] for r in E.predict(model, df.where("id < 50"), ["id"]).collect()}
    import numpy as np
    y = np.array([(i % n) % 17 + i // n for i in range(2 * n)], dtype=float).reshape(2, n)
    # per category two rows: b_c = 2 (mean_c - a) / (2 + 1); the intercept a solves sum(y - a - b) = 0
    a = y.mean()
    want = a + 2 * (y.mean(axis=0) - a) / 3
    assert all(abs(got[i] - want[i]) < 1e-4 for i in range(50))
