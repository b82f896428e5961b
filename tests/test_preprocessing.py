import pytest
from pyspark.sql import functions as F

from tessera.config import FeatureOverrides, Imputation, PreprocessingConfig, PreprocessingError, Task
from tessera.operators import features as FE
from tessera.operators import split as T


def leak_frame(spark, replace_validation=None, parts=None):
    rows = [(i, None if i in (2, 7) else i, 1.5 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id int, value int, target double")
    s = T.split_dataset(df, target="target", key=["row_id"], task=Task.REGRESSION)
    frame = s.frame
    if replace_validation is not None:
        frame = frame.withColumn("value", F.when(F.col("part") == "validation", F.lit(replace_validation))
                                 .otherwise(F.col("value")))
    return frame


def test_statistics_come_from_training_rows_only(spark):
    schema = FE.FeatureSchema(("value",), ("value",), ())
    base = FE.fit_feature_stats(leak_frame(spark), schema, where=F.col("part") == "train")
    leaked = FE.fit_feature_stats(leak_frame(spark, 1_000_000), schema, where=F.col("part") == "train")
    assert base.fill == leaked.fill and base.center == leaked.center and base.scale == leaked.scale


def test_median_mean_and_population_scale(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 10.0)], "k int, x double")
    schema = FE.FeatureSchema(("x",), ("x",), ())
    st = FE.fit_feature_stats(df, schema)
    assert st.fill["x"] == 2.0  # median of 1, 2, 10
    imputed = [1.0, 2.0, 2.0, 10.0]
    mean = sum(imputed) / 4
    assert st.center["x"] == pytest.approx(mean)
    assert st.scale["x"] == pytest.approx((sum((v - mean) ** 2 for v in imputed) / 4) ** 0.5)
    st_mean = FE.fit_feature_stats(df, schema, PreprocessingConfig(Imputation.MEAN, scale_numeric=False))
    assert st_mean.fill["x"] == pytest.approx(13 / 3) and st_mean.scale == {}


def test_empty_numeric_column_kept(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, e double")
    schema = FE.infer_feature_schema(df, ["k", "e"])
    st = FE.fit_feature_stats(df, schema)
    assert st.fill["e"] == 0.0 and st.scale["e"] == 1.0
    assert "numeric__e" in st.output_names()


def test_roles_overrides_and_unsupported(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    schema = FE.infer_feature_schema(df, ["o_custkey", "o_orderstatus", "o_totalprice"],
                                     FeatureOverrides(categorical=("o_custkey",)))
    assert schema.numeric == ("o_totalprice",) and schema.categorical == ("o_custkey", "o_orderstatus")
    with pytest.raises(PreprocessingError, match="Unsupported"):
        FE.infer_feature_schema(df, ["o_orderdate"])
    with pytest.raises(PreprocessingError, match="unknown"):
        FE.infer_feature_schema(df, ["o_totalprice"], FeatureOverrides(numeric=("nope",)))
    with pytest.raises(PreprocessingError, match="forced numeric"):
        FE.infer_feature_schema(df, ["o_orderstatus"], FeatureOverrides(numeric=("o_orderstatus",)))


def test_unseen_category_is_all_zero_and_marker_filled(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, city string")
    schema = FE.infer_feature_schema(train, ["city"])
    st = FE.fit_feature_stats(train, schema)
    marker = st.config.categorical_fill_value
    assert st.categories["city"] == sorted(["a", "b", marker])
    model = FE.fit_preprocessor(train, st)
    new = spark.createDataFrame([(9, "zzz"), (10, "b")], "k int, city string")
    vecs = {r["k"]: r["features"].toArray().tolist() for r in model.transform(new).collect()}
    assert vecs[9] == [0.0, 0.0, 0.0]
    assert sum(vecs[10]) == 1.0


def test_marker_collision_and_infinite_rejected(spark):
    df = spark.createDataFrame([(1, "x", 1.0, "train"), (2, "__tessera_missing__", 2.0, "validation")],
                               "k int, c string, v double, part string")
    schema = FE.infer_feature_schema(df, ["c", "v"])
    with pytest.raises(PreprocessingError, match="fill value"):
        FE.validate_preprocessing_inputs(df, schema, PreprocessingConfig())
    bad = spark.createDataFrame([(1, float("inf"), "train")], "k int, v double, part string")
    with pytest.raises(PreprocessingError, match="infinite"):
        FE.validate_preprocessing_inputs(bad, FE.infer_feature_schema(bad, ["v"]), PreprocessingConfig())


def test_all_fold_statistics_equal_per_fold_fits(spark):
    from tessera.config import FoldConfig
    from tessera.operators import split as T

    rows = [(i, None if i % 7 == 0 else float(i * i % 23), "xyz"[i % 3] if i % 11 else None, "ab"[i % 2])
            for i in range(90)]
    df = spark.createDataFrame(rows, "k int, x double, c string, target string")
    folded = T.assign_folds(df, target="target", key=["k"], config=FoldConfig(3, 5))
    schema = FE.infer_feature_schema(df, ["x", "c"])
    for cfg in (PreprocessingConfig(), PreprocessingConfig(Imputation.MEAN)):
        batch = FE.fit_fold_feature_stats(folded, schema, cfg, 3)
        for k in (1, 2, 3):
            single = FE.fit_feature_stats(folded, schema, cfg, where=F.col("fold") != k)
            assert batch[k].fill == pytest.approx(single.fill)
            assert batch[k].center == pytest.approx(single.center)
            assert batch[k].scale == pytest.approx(single.scale)
            assert batch[k].categories == single.categories
            assert batch[k].training_rows == single.training_rows


def test_fold_violations_name_the_failing_side(spark):
    from tessera.config import FoldConfig
    from tessera.operators import split as T

    df = spark.createDataFrame([(i, float("inf") if i == 4 else 1.0, "ab"[i % 2]) for i in range(12)],
                               "k int, v double, target string")
    folded = T.assign_folds(df, target="target", key=["k"], config=FoldConfig(3, 1))
    bad_fold = folded.filter("k = 4").first()["fold"]
    msgs = FE.fold_input_violations(folded, FE.infer_feature_schema(df, ["v"]), PreprocessingConfig(), 3)
    assert msgs[bad_fold].startswith("Validation")
    assert all(msgs[k].startswith("Training") for k in (1, 2, 3) if k != bad_fold)


def test_custom_estimator_pipeline_and_table_validation(spark):
    from pyspark.ml.regression import GBTRegressor

    from tessera.config import DatasetError, TableSpec
    from tessera.operators import checks
    from tessera.operators import estimators as E

    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], 2.0 * i) for i in range(30)],
                               "k int, x double, c string, y double")
    stats = FE.fit_feature_stats(df, FE.infer_feature_schema(df, ["x", "c"]))
    model = E.build_model_pipeline(stats, GBTRegressor(labelCol="y", maxIter=3)).fit(df)
    assert model.transform(df).select("prediction").count() == 30
    spec = TableSpec(target="y", key=("k",), fields=tuple(df.columns))
    checks.validate_table(df, spec)
    with pytest.raises(DatasetError):
        checks.validate_table(df.drop("c"), spec)


def test_fold_medians_of_skewed_and_missing_values(spark):
    import statistics

    from tessera.operators.quantile import fold_medians

    rows = [(c, i % 3 + 1, float(v)) for c, values in
            {"many": [i * 7 % 1000 for i in range(1000)], "one": [5] * 30, "hot": [1] * 400 + list(range(200)),
             "few": [3, 8], "gone": [4]}.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, fold int, v double").repartition(4)
    got = fold_medians(df, ["g"], "fold", 3)
    for g in ("many", "one", "hot", "few", "gone"):
        left = [[v for c, f, v in rows if c == g and f != k] for k in (1, 2, 3)]
        assert got[g,] == [statistics.median(x) if x else None for x in left]
    assert fold_medians(df.where("v is null"), ["g"], "fold", 3) == {}
