"""Forests on counted rows are the forests of Spark's own fit."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from tessera.config import ForestConfig, Task
from tessera.operators import estimators as E
from tessera.operators import features as FE


def _rows(spark, n=3000):
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    return spark.range(n).select(
        "id", (h(1, 12) / 4).alias("amount"), F.when(h(2, 4) > 0, h(2, 4)).alias("size"),
        F.element_at(F.array(*[F.lit(c) for c in "abc"]), (h(3, 3) + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*[F.lit(c) for c in "xyz"]), (F.pmod(h(1, 12) + h(4, 2), F.lit(3)) + 1).cast("int"))
        .alias("y"))


def _fit(rows, trees=6):
    schema = FE.infer_feature_schema(rows, ["amount", "size", "kind"])
    return E.fit_estimator(rows, FE.fit_feature_stats(rows, schema), target="y", estimator=E.RANDOM_FOREST_CLASSIFIER,
                           task=Task.CLASSIFICATION, seed=7, key=["id"],
                           forest_config=ForestConfig(trees=trees, max_depth=6))


def _grown(model):
    return [line for line in model.model.stages[-3].toDebugString.splitlines() if "uid=" not in line]


def test_counted_rows_grow_the_same_forest(spark, monkeypatch):
    rows = _rows(spark)
    monkeypatch.setattr(E.forest, "ROWS_PER_COUNTED_ROW", float("inf"))
    plain = _fit(rows)
    monkeypatch.undo()

    def row_by_row(self, *_):
        raise AssertionError("every row was visited for every tree and level")

    monkeypatch.setattr(RandomForestClassifier, "fit", row_by_row)
    counted = _fit(rows)
    assert _grown(counted) == _grown(plain) and len(_grown(plain)) > 100
    assert counted.parameters == plain.parameters and counted.labels == plain.labels
    a, b = (E.predict(m, rows, ["id"]) for m in (counted, plain))
    assert a.schema == b.schema and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("partitions", [1, 3])
def test_draws_are_those_of_sparks_bootstrap(spark, partitions):
    """One Poisson(1) generator a partition, drawn on for each row."""
    df = spark.range(0, 60, 1, partitions)
    got = df.select(F.spark_partition_id().alias("p"), "id",
                    E.forest.bootstrap_counts(df, 5, 42, partitions).alias("c")).orderBy("id").collect()
    for p in range(partitions):
        drawn = spark._jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0)
        drawn.reseedRandomGenerator(42 + p + 1)
        assert [list(r["c"]) for r in got if r["p"] == p] == [list(drawn.sample(5)) for r in got if r["p"] == p]
