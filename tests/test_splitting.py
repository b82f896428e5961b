import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.config import ConfigurationError, FoldConfig, SplitConfig, SplitError, Task
from tessera.functions.columns import seeded_hash
from tessera.operators import checks
from tessera.operators import split as T


def binary(spark, n=20):
    return spark.createDataFrame([(i, "yes" if i % 2 else "no") for i in range(n)], "value int, target string")


def test_stratified_counts_and_disjoint(spark):
    s = T.split_dataset(binary(spark), target="target", key=["value"], task=Task.CLASSIFICATION,
                        config=SplitConfig(validation_fraction=0.25, random_seed=7))
    counts = sorted(r["count"] for r in s.validation().groupBy("target").count().collect())
    assert counts == [2, 3]
    integrity = checks.split_integrity(s.frame, ["value"]).first()
    assert integrity["keys_in_both_parts"] == 0 and integrity["rows"] == 20
    assert integrity["validation_rows"] == 5


def test_regression_holdout_sizes(spark):
    df = spark.createDataFrame([(i, i / 10) for i in range(10)], "value int, target double")
    s = T.split_dataset(df, target="target", key=["value"], task=Task.REGRESSION)
    assert (s.train_rows, s.validation_rows) == (8, 2)
    assert s.validation().count() == 2
    with pytest.raises(SplitError):
        T.split_dataset(df, target="target", key=["value"], task=Task.REGRESSION,
                        config=SplitConfig(stratify=True))


def test_split_is_deterministic_and_seeded(spark):
    df = binary(spark, 60)
    a = T.split_dataset(df, target="target", key=["value"], task=Task.CLASSIFICATION)
    b = T.split_dataset(df.repartition(7), target="target", key=["value"], task=Task.CLASSIFICATION)
    c = T.split_dataset(df, target="target", key=["value"], task=Task.CLASSIFICATION,
                        config=SplitConfig(random_seed=43))
    assert a.partition_sha256() == b.partition_sha256()
    assert a.partition_sha256() != c.partition_sha256()


def test_folds_spread_every_class(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "value int, target string")
    folded = T.assign_folds(df, target="target", key=["value"], config=FoldConfig(5, 17))
    counts = {(r["fold"], r["target"]): r["count"] for r in folded.groupBy("fold", "target").count().collect()}
    assert set(counts.values()) == {2} and len(counts) == 15
    snaps = T.fold_snapshots(folded, ["value"], 5).collect()
    assert sorted(r["validation_rows"] for r in snaps) == [6] * 5
    assert len({r["partition_sha256"] for r in snaps}) == 5


def test_fold_feasibility_errors(spark):
    df = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(7)], "value int, target string")
    with pytest.raises(SplitError):
        T.assign_folds(df, target="target", key=["value"], config=FoldConfig(4, 1))
    with pytest.raises(ConfigurationError):
        FoldConfig(fold_count=11)
    with pytest.raises(ConfigurationError):
        SplitConfig(validation_fraction=1.0)


def test_missing_target_rejected(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "b")], "value int, target string")
    with pytest.raises(SplitError, match="missing"):
        T.split_dataset(df, target="target", key=["value"], task=Task.CLASSIFICATION)


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_bucketed_rank_equals_global_window(spark, digits):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus")
    hashed = df.withColumn("_h", seeded_hash(42, ["o_orderkey"]))
    ours = T.ordered_rank(hashed, ["o_orderkey"], prefix=["o_orderstatus"], digits=digits, groups_bound=3)
    ref = hashed.withColumn("_ref", F.row_number().over(Window.orderBy("o_orderstatus", "_h", "o_orderkey")) - 1)
    joined = ours.join(ref.select("o_orderkey", "_ref"), "o_orderkey")
    assert joined.filter(F.col("_rank") != F.col("_ref")).count() == 0
    assert joined.count() == df.count()


def test_unchecked_split_keeps_rows_with_missing_target(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(40)],
                               "value int, target string")
    s = T.split_dataset(df, target="target", key=["value"], task=Task.CLASSIFICATION, check=False,
                        config=SplitConfig(stratify=False))
    assert s.frame.count() == 40
    folded = T.assign_folds(df, target="target", key=["value"], check=False, rows=40, classes=3)
    assert folded.count() == 40 and folded.filter("target IS NULL").count() == 8


def test_duplicate_keys_rejected(spark):
    df = spark.createDataFrame([(i % 10, "ab"[i % 2]) for i in range(20)], "value int, target string")
    with pytest.raises(SplitError, match="not unique"):
        T.split_dataset(df, target="target", key=["value"], task=Task.CLASSIFICATION)
    with pytest.raises(SplitError, match="not unique"):
        T.assign_folds(df, target="target", key=["value"], config=FoldConfig(2, 1))


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("validation", [1, 17, 99])
def test_holdout_marks_rows_where_they_are(spark, digits, validation):
    """The rows before the last validation row, no matter where its bucket
    ends; no row changes its partition."""
    df = spark.range(0, 100, 1, 4).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id"),
                                          F.spark_partition_id().alias("at"))
    hashed = df.withColumn("_h", seeded_hash(42, ["k", "id"]))
    got = T.quota_part(hashed, ["k", "id"], validation, digits=digits).withColumn("now", F.spark_partition_id())
    ranked = T.ordered_rank(hashed, ["k", "id"], digits=digits)
    first = {r["id"] for r in ranked.filter(F.col("_rank") < validation).collect()}
    rows = got.collect()
    assert {r["id"] for r in rows if r["part"] == "validation"} == first and len(rows) == 100
    assert all(r["at"] == r["now"] for r in rows)


def test_stratified_holdout_keeps_quotas_of_uneven_classes(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 150, "a").when(F.col("id") < 197, "b")
                                .otherwise("c").alias("y"))
    s = T.split_dataset(df, target="y", key=["id"], task=Task.CLASSIFICATION, config=SplitConfig(random_seed=3))
    hashed = df.withColumn("_h", seeded_hash(3, ["id"]))
    ranked = T.ordered_rank(hashed, ["id"], partition=["y"])
    quotas = {r["y"]: r["count"] for r in s.validation().groupBy("y").count().collect()}
    assert sum(quotas.values()) == 40 and s.frame.count() == 200
    assert {r["id"] for r in s.validation().collect()} == {
        r["id"] for r in ranked.collect() if r["_rank"] < quotas.get(r["y"], 0)}
