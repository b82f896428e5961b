import os

import pytest

from tessera.config import Task
from tessera.operators import estimators as E
from tessera.plans import artifacts as A
from tessera.plans.registry import Registry
from tessera.plans.scoring import number_rows, predict_frame, write_predictions_csv
from tessera.plans.train import TrainingConfig, train
from tessera.streaming.scoring import score_stream


def test_model_save_inspect_and_stream_scoring(spark, scratch):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    reg = Registry(spark, os.path.join(scratch, "registry"))
    res = train(orders, TrainingConfig(Task.CLASSIFICATION, E.DUMMY_CLASSIFIER), target="o_orderstatus",
                key=["o_orderkey"], registry=reg)
    meta = A.save(reg, res.model, res.stats, orders, task="classification", target="o_orderstatus",
                  lineage_kind="run", lineage_id=res.record["run_id"])
    assert [f["role"] for f in A.inspect(reg, res.record["run_id"])["features"]] == \
        ["numeric", "numeric", "categorical"]
    with pytest.raises(Exception):
        res.model.model.write().save(meta["model_path"])  # create-only
    artifact = A.load(reg, res.record["run_id"])
    features = orders.drop("o_orderstatus")
    batch = predict_frame(artifact, features, key=["o_orderkey"])
    assert batch.count() == orders.count()

    src = os.path.join(scratch, "incoming")
    features.write.parquet(src)
    query = score_stream(artifact, spark.readStream.schema(features.schema).parquet(src), key=["o_orderkey"],
                         output_path=os.path.join(scratch, "scored"),
                         checkpoint_location=os.path.join(scratch, "stream-ckpt"))
    query.awaitTermination(120)
    scored = spark.read.parquet(os.path.join(scratch, "scored")).drop("batch_id")
    assert scored.count() == orders.count()
    assert scored.exceptAll(batch).count() == 0

    out = write_predictions_csv(number_rows(batch, ["o_orderkey"]), os.path.join(scratch, "pred_csv"))
    assert spark.read.option("header", True).csv(out).count() == orders.count()
    with pytest.raises(Exception):
        write_predictions_csv(number_rows(batch, ["o_orderkey"]), out)  # never overwrites


@pytest.fixture()
def ridge(spark):
    """(artifact, rows): a ridge model of y on x and a category."""
    from pyspark.sql import functions as F

    from tessera.operators import features as FE
    from tessera.plans.artifacts import Artifact, feature_contract

    rows = spark.range(60, numPartitions=4).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"),
        (F.col("id") * 2.0).alias("y"))
    stats = FE.fit_feature_stats(rows, FE.infer_feature_schema(rows, ["x", "c"]))
    fitted = E.fit_estimator(rows, stats, target="y", estimator=E.RIDGE_REGRESSION, task=Task.REGRESSION, seed=1,
                             key=["id"])
    meta = {"features": feature_contract(rows, stats), "categorical_fill_value": stats.config.categorical_fill_value}
    return Artifact(meta, fitted.model), rows.drop("y")


def test_score_table_checks_and_commits_in_one_pass(spark, scratch, ridge):
    from tessera.config import PredictionSchemaError
    from tessera.plans.scoring import score_table

    artifact, rows = ridge
    out = os.path.join(scratch, "scores")
    assert score_table(artifact, rows, out, key=["id"]) == 60
    back = spark.read.parquet(out)
    assert back.columns == ["id", "prediction"]
    assert back.exceptAll(predict_frame(artifact, rows, key=["id"])).count() == 0 and back.count() == 60
    with pytest.raises(PredictionSchemaError, match="exists"):
        score_table(artifact, rows, out, key=["id"])
    assert score_table(artifact, rows.limit(7), out, key=["id"], replace=True) == 7
    assert spark.read.parquet(out).count() == 7
    assert os.listdir(scratch) == ["scores"]


def test_a_refusal_leaves_no_output(spark, scratch, ridge):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    from pyspark.sql import functions as F

    from tessera.config import PredictionSchemaError
    from tessera.plans.artifacts import Artifact
    from tessera.plans.scoring import score_table

    artifact, rows = ridge
    marker = artifact.metadata["categorical_fill_value"]
    spoil = {
        "infinite": rows.withColumn("x", F.when(F.col("id") == 41, float("inf")).otherwise(F.col("x"))),
        "reserved": rows.withColumn("c", F.when(F.col("id") == 3, marker).otherwise(F.col("c"))),
        "no rows": rows.where("id < 0"),
    }
    for reason, bad in spoil.items():
        with pytest.raises(PredictionSchemaError, match=reason):
            score_table(artifact, bad, os.path.join(scratch, "scores"), key=["id"])
        assert os.listdir(scratch) == []

    def ending(statement):
        return Artifact(artifact.metadata, PipelineModel([*artifact.model.stages, SQLTransformer(statement=statement)]))

    for broken, reason in ((ending("SELECT * FROM __THIS__ WHERE id <> 5"), "59 predictions for 60 rows"),
                           (ending("SELECT * EXCEPT (prediction), IF(id = 9, double('nan'), prediction) AS prediction "
                                   "FROM __THIS__"), "missing or infinite")):
        with pytest.raises(PredictionSchemaError, match=reason):
            score_table(broken, rows, os.path.join(scratch, "scores"), key=["id"])
        assert os.listdir(scratch) == []
