"""Schema-checked batch scoring.

``predict_frame`` checks the values with one aggregation and returns a lazy
frame.  ``score_table`` scores and checks in one pass over the input: the
checks are observed metrics of the writing job, whose output stays in a
staging folder until they have been read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import PredictionSchemaError
from ..functions.columns import is_infinite, is_numeric_type, kind_of
from ..operators import checks
from ..session import checkpoint_dir
from .artifacts import Artifact


def validate_scoring_frame(artifact: Artifact, df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """V14 + V15: names, order, numeric roles finite, no reserved marker."""
    ordered = scoring_columns(artifact, df, extra)
    _refuse(artifact, ordered.agg(*_input_facts(artifact, ordered)).first().asDict())
    return ordered


def scoring_columns(artifact: Artifact, df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """V14 on the schema alone: the extra columns and the features in order."""
    expected = artifact.feature_names
    extra = [c for c in (extra or []) if c not in expected]
    checks.check_scoring_columns([c for c in df.columns if c not in extra], expected)
    ordered = df.select(*extra, *expected)
    fields = {f.name: f.dataType for f in ordered.schema.fields}
    for f in artifact.metadata["features"]:
        name, dtype = f["name"], fields[f["name"]]
        if f["role"] == "numeric" and not is_numeric_type(dtype):
            raise PredictionSchemaError(
                f"Numeric feature {name!r} has incompatible type {dtype.simpleString()}; "
                f"training type was {f['dtype']}.")
        if f["role"] != "numeric" and kind_of(dtype) == "other":
            raise PredictionSchemaError(f"Categorical feature {name!r} must hold scalar values.")
    return ordered


def _input_facts(artifact: Artifact, ordered: DataFrame) -> list:
    """Aggregates that V15 needs: rows, and the unusable values by feature."""
    marker = artifact.metadata["categorical_fill_value"]
    facts = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(artifact.metadata["features"]):
        col = F.col(f"`{f['name']}`")
        bad = is_infinite(col.cast("double")) if f["role"] == "numeric" else col.cast("string") == marker
        facts.append(F.count_if(bad).alias(f"bad_{i}"))
    return facts


def _refuse(artifact: Artifact, facts: dict) -> None:
    """The first feature with an unusable value ends the scoring."""
    if not facts["rows"]:
        raise PredictionSchemaError("The scoring table has no rows.")
    for i, f in enumerate(artifact.metadata["features"]):
        if facts[f"bad_{i}"]:
            if f["role"] == "numeric":
                raise PredictionSchemaError(f"Scoring input has infinite values in numeric feature {f['name']!r}.")
            raise PredictionSchemaError(
                f"Scoring input uses the reserved fill value "
                f"{artifact.metadata['categorical_fill_value']!r} in {f['name']!r}.")


def _unusable(scored: DataFrame):
    """Whether a prediction is missing or not finite."""
    value = F.col("prediction")
    if is_numeric_type(scored.schema["prediction"].dataType):
        return value.isNull() | F.isnan(value) | is_infinite(value)
    return value.isNull()


def score_table(artifact: Artifact, df: DataFrame, path: str, *, key: list[str] | None = None,
                replace: bool = False) -> int:
    """I1 with V14-V16 in one pass: writes ``(key..., prediction)`` as Parquet
    to ``path`` and returns the number of rows.

    The job counts rows and unusable values on its way in and rows and
    unusable predictions on its way out, and writes to a staging folder
    beside ``path``.  Only after all counts are found right the folder gets
    its name; a refusal removes it, so ``path`` never holds half a result.
    ``replace`` allows an existing ``path`` (a replayed batch); otherwise it
    is an error before anything is read.  Work done again after a lost
    executor may be counted again, so differing counts are taken anew from the
    input and the staged files before they count.
    """
    spark, key = df.sparkSession, list(key or [])
    ordered = scoring_columns(artifact, df, key)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, staged = hadoop.Path(path.rstrip("/")), hadoop.Path(f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not replace and files.exists(target):
        raise PredictionSchemaError(f"{path} exists; predictions are never overwritten.")
    before, after = Observation(), Observation()
    facts = _input_facts(artifact, ordered)
    scored = artifact.model.transform(ordered.observe(before, *facts)).select(*key, "prediction")
    scored = scored.observe(after, F.count(F.lit(1)).alias("rows"), F.count_if(_unusable(scored)).alias("bad"))
    try:
        scored.write.parquet(staged.toString())
        seen, made = before.get, after.get
        if seen["rows"] != made["rows"]:
            seen = ordered.agg(*facts).first().asDict()
            back = spark.read.schema(scored.schema).parquet(staged.toString())
            made = back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(_unusable(back)).alias("bad")).first().asDict()
        _refuse(artifact, seen)
        if made["rows"] != seen["rows"]:
            raise PredictionSchemaError(f"{made['rows']} predictions for {seen['rows']} rows.")
        if made["bad"]:
            raise PredictionSchemaError("The model returned a missing or infinite prediction.")
        if replace:
            files.delete(target, True)
        if not files.rename(staged, target):
            raise PredictionSchemaError(f"Predictions could not be moved to {path}.")
    finally:
        files.delete(staged, True)
    return int(made["rows"])


def predict_frame(artifact: Artifact, df: DataFrame, *, key: list[str] | None = None) -> DataFrame:
    """Validated predictions ``(key..., prediction)`` in label space."""
    key = list(key or [])
    ordered = validate_scoring_frame(artifact, df, key)
    scored = artifact.model.transform(ordered).select(*key, "prediction")
    # V16 in the same pass: a missing or non-finite prediction ends the job.
    return scored.withColumn("prediction", F.when(
        _unusable(scored), F.raise_error(F.lit("The model returned a missing or infinite prediction.")))
        .otherwise(F.col("prediction")))


def predict_csv(spark, artifact: Artifact, path: str, *, key: list[str] | None = None,
                options=None) -> DataFrame:
    """Strict CSV load (S2) then ``predict_frame``."""
    from ..sources.csv import load_feature_csv

    return predict_frame(artifact, load_feature_csv(spark, path, options=options), key=key)


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """1-based ``row_number`` in ``order`` without a single-task window.

    The range-sorted frame is checkpointed to the shared checkpoint folder
    (so partition contents are fixed even if executors are lost); row
    numbers = rows in earlier partitions (small prefix-sum table) +
    position inside the partition.
    """
    checkpoint_dir(df.sparkSession)
    sorted_df = df.orderBy(*order).checkpoint(eager=True)
    tagged = sorted_df.withColumn("_mid", F.monotonically_increasing_id()).withColumn(
        "_pid", F.shiftright("_mid", 33))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    from pyspark.sql import Window

    offsets = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n"))
    # One row per partition: a bounded broadcast.
    return tagged.join(F.broadcast(offsets), "_pid").withColumn(
        "row_number", F.col("_off") + (F.col("_mid") - F.col("_first")) + 1
    ).drop("_mid", "_pid", "_n", "_first", "_off")


def check_prediction_count(predictions: DataFrame, input_rows: int) -> None:
    """Finite predictions and one per input row."""
    row = checks.prediction_sanity(predictions).first()
    if row["rows"] != input_rows:
        raise PredictionSchemaError("The model returned a different number of rows than it was given.")
    if row["invalid_predictions"]:
        raise PredictionSchemaError("The model returned a missing or infinite prediction.")


def write_predictions_csv(predictions: DataFrame, path: str) -> str:
    """Create-only CSV ``row_number,prediction`` (never overwrites)."""
    predictions.select("row_number", "prediction").write.mode("errorifexists").option(
        "header", True).csv(path)
    return path
