"""Dictionary-encoded columns give the models that listed columns give."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tessera.config import FeatureOverrides, FoldConfig, Task
from tessera.operators import dictionary as D
from tessera.operators import estimators as E
from tessera.operators import features as FE
from tessera.operators import split as T
from tessera.plans import crossval as CV
from tessera.plans import final as G

MARKER = "__missing__"


@pytest.fixture()
def rows(spark):
    """A third of the rows hold one city; 120 others and missing ones."""
    h = lambda m: F.pmod(F.hash("id"), F.lit(m))
    city = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 41 == 0, None).otherwise(
        F.concat(F.lit("c."), h(120)))
    return spark.range(900).select(
        "id", city.alias("city"), F.concat(F.lit("k"), h(7)).alias("kind"), (h(50) / 7).alias("x"),
        (h(120) % 9 + h(7) * 2 + F.when(F.col("id") % 3 == 0, 5).otherwise(0)).cast("double").alias("y"),
        F.when(h(120) % 5 < 2, "a").when(h(7) < 3, "b").otherwise("c").alias("label"))


def both(rows, features, target, estimator, task, limit=20):
    schema = FE.infer_feature_schema(rows, features)
    out = []
    for bound in (None, limit):
        stats = FE.fit_feature_stats(rows, schema, list_limit=bound, where=F.col("id") % 5 != 0)
        out.append((stats, E.fit_estimator(rows.where("id % 5 <> 0"), stats, target=target, estimator=estimator,
                                           task=task, seed=1, key=["id"])))
    return out


def predicted(fitted, rows):
    model = fitted.model if isinstance(fitted, E.FittedModel) else fitted
    return {r["id"]: r["prediction"] for r in model.transform(rows).select("id", "prediction").collect()}


def test_ranks_are_sorted_positions_for_every_fold(spark, rows):
    folded = rows.withColumn("fold", (F.col("id") % 4 + 1).cast("int"))
    d = D.build_dictionary(folded, ["city", "kind"], MARKER, fold="fold", fold_count=4)
    got = d.table(spark).collect()
    held = {}
    for r in folded.collect():
        for c in ("city", "kind"):
            held.setdefault(c, []).append((r[c] or MARKER, r["fold"]))
    for c, pairs in held.items():
        mine = {r["value"]: r for r in got if r["column_name"] == c}
        for name, values in [("rank", {v for v, _ in pairs})] + [
                (f"rank_{k}", {v for v, f in pairs if f != k}) for k in range(1, 5)]:
            want = {v: i for i, v in enumerate(sorted(values))}
            assert {v: r[name] for v, r in mine.items() if r[name] is not None} == want
            assert d.sizes[name][c] == len(want)
        assert sum(r["n"] for r in mine.values()) == len(pairs)


@pytest.mark.parametrize("estimator,task,target", [
    (E.RIDGE_REGRESSION, Task.REGRESSION, "y"), (E.LOGISTIC_REGRESSION, Task.CLASSIFICATION, "label")])
def test_same_predictions_as_with_lists(spark, rows, scratch, estimator, task, target):
    (listed, a), (wide, b) = both(rows, ["city", "kind", "x"], target, estimator, task)
    assert listed.wide == [] and wide.wide == ["city"] and wide.listed == ["kind"] and listed.width == wide.width
    names = {r["name"] for r in wide.output_positions(spark).collect()}
    assert names == set(listed.output_names())
    unseen = rows.limit(3).withColumn("city", F.lit("never seen")).withColumn("id", F.col("id") + 5000)
    scored = rows.unionByName(unseen)
    pa, pb = predicted(a, scored), predicted(b, scored)
    assert pa.keys() == pb.keys()
    if task is Task.REGRESSION:
        assert max(abs(pa[i] - pb[i]) for i in pa) < 1e-6
    else:
        assert pa == pb
    b.model.write().save(f"{scratch}/model")  # the weights table goes with the model
    again = PipelineModel.load(f"{scratch}/model")
    assert predicted(again, scored) == pb
    assert f"{scratch}/model" in again.stages[-1 if task is Task.REGRESSION else -3].getOrDefault("table")


def test_two_classes_and_no_other_features(spark, rows):
    two = rows.withColumn("label", F.when(F.col("y") > 9, "hi").otherwise("lo"))
    (_, a), (stats, b) = both(two, ["city"], "label", E.LOGISTIC_REGRESSION, Task.CLASSIFICATION)
    assert stats.list_width == 0
    assert predicted(a, two) == predicted(b, two)
    (_, a), (_, b) = both(two, ["city"], "y", E.RIDGE_REGRESSION, Task.REGRESSION)
    pa, pb = predicted(a, two), predicted(b, two)
    assert max(abs(pa[i] - pb[i]) for i in pa) < 1e-6


def test_forests_refuse_wide_columns(rows):
    with pytest.raises(E.TrainingError, match="limited size"):
        both(rows, ["city", "x"], "y", E.RANDOM_FOREST_REGRESSOR, Task.REGRESSION)[1]


def test_cross_validation_and_refit_give_the_listed_results(spark, rows, monkeypatch):
    cfg = CV.CrossValidationConfig(estimators=(E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION), folds=FoldConfig(2, 7),
                                   overrides=FeatureOverrides(numeric=("id",)))
    table = rows.select("id", "city", "kind", "x", "label")
    records = []
    for limit in (100_000, 10):
        monkeypatch.setattr(FE, "LIST_CATEGORIES", limit)
        record = CV.cross_validate(table, cfg, target="label", key=["id"]).record
        final = G.fit_selected_model(table, record, target="label", key=["id"])
        assert final.stats.wide == ([] if limit > 10 else ["city", "kind"])
        records.append(([e["metrics"] for e in record["entries"]], predicted(final.model, table)))
    assert records[0] == records[1]


def test_more_categories_than_are_listed(spark):
    """Each value has one row but for a hot one; the closed form is known."""
    n = 200_000
    rows = spark.range(n + 1000, numPartitions=8).select(
        "id", F.when(F.col("id") < n, F.concat(F.lit("v"), "id")).otherwise("hot").alias("city"),
        F.pmod(F.hash("id"), F.lit(100)).cast("double").alias("y"))
    schema = FE.infer_feature_schema(rows, ["city"])
    stats = FE.fit_feature_stats(rows, schema)
    assert stats.wide == ["city"] and stats.width == n + 1
    fitted = E.fit_estimator(rows, stats, target="y", estimator=E.RIDGE_REGRESSION, task=Task.REGRESSION, seed=1,
                             key=["id"])
    assert ("converged", "true") in fitted.parameters
    s = rows.agg(F.sum(F.when(F.col("id") < n, F.col("y"))), F.sum(F.when(F.col("id") >= n, F.col("y")))).first()
    # (m + 1) w = sum(y) - m b in every category, and the residuals sum to zero
    b = (s[0] / 2 + s[1] / 1001) / (n / 2 + 1000 / 1001)
    some = rows.where("id % 10007 = 7 or id >= 200990")
    for r in fitted.model.transform(some).select("id", "y", "prediction").collect():
        want = b + ((r["y"] - b) / 2 if r["id"] < n else (s[1] - 1000 * b) / 1001)
        assert abs(r["prediction"] - want) < 1e-6


def test_the_split_frame_still_encodes(spark, rows):
    frame = T.split_dataset(rows, target="y", key=["id"], task=Task.REGRESSION).frame
    stats = FE.fit_feature_stats(frame, FE.infer_feature_schema(frame, ["city", "x"]), where=F.col("part") == "train",
                                 list_limit=0)
    train = E.preprocessing_stages(stats)
    assert stats.wide == ["city"] and len(train) == 2
