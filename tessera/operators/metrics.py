"""Classification and regression metrics from one prediction table.

Input: ``(group..., actual, predicted)``.  Classification metrics come from
the confusion table ``groupBy(group, actual, predicted).count()`` -- a
partial aggregation whose output is bounded by groups x labels^2 -- so the
per-label arithmetic never touches the row-level data again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TrainingError

# Metric names and directions.
CLASSIFICATION_METRICS = (
    ("accuracy", True),
    ("balanced_accuracy", True),
    ("f1_macro", True),
    ("f1_weighted", True),
    ("precision_macro", True),
    ("recall_macro", True),
)
REGRESSION_METRICS = (
    ("mean_absolute_error", False),
    ("r2", True),
    ("root_mean_squared_error", False),
)


def confusion_table(pred: DataFrame, group: list[str], actual="actual", predicted="predicted") -> DataFrame:
    """``(group..., actual, predicted, count)`` with labels as text."""
    return pred.groupBy(
        *group,
        F.col(actual).cast("string").alias("actual"),
        F.col(predicted).cast("string").alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("count"))


def per_label(confusion: DataFrame, group: list[str]) -> DataFrame:
    """Support, predicted count and true positives per label (union of labels)."""
    c = F.col("count")
    contrib = confusion.select(*group, F.inline(F.array(
        F.struct(F.col("actual").alias("label"), c.alias("sup"), F.lit(0).cast("bigint").alias("pred"),
                 F.when(F.col("actual") == F.col("predicted"), c).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("sup"), c.alias("pred"),
                 F.lit(0).cast("bigint").alias("tp")),
    )))
    return contrib.groupBy(*group, "label").agg(
        F.sum("sup").alias("sup"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp")
    )


def classification_metrics(pred: DataFrame, group: list[str] | None = None,
                           actual="actual", predicted="predicted") -> DataFrame:
    """M1-M6 per group, long form ``(group..., metric, value, higher_is_better)``."""
    group = list(group or [])
    labels = per_label(confusion_table(pred, group, actual, predicted), group)
    sup, prd, tp = F.col("sup"), F.col("pred"), F.col("tp")
    f1 = F.when(sup + prd > 0, 2.0 * tp / (sup + prd)).otherwise(0.0)
    wide = labels.groupBy(*group).agg(
        (F.sum(tp) / F.sum(sup)).alias("accuracy"),
        F.avg(F.when(sup > 0, tp / sup)).alias("balanced_accuracy"),
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * sup) / F.sum(sup)).alias("f1_weighted"),
        F.avg(F.when(prd > 0, tp / prd).otherwise(0.0)).alias("precision_macro"),
        F.avg(F.when(sup > 0, tp / sup).otherwise(0.0)).alias("recall_macro"),
    )
    return _long(wide, group, CLASSIFICATION_METRICS)


def regression_metrics(pred: DataFrame, group: list[str] | None = None,
                       actual="actual", predicted="predicted") -> DataFrame:
    """M7-M9 per group; constant actuals give r2 1.0 if perfect else 0.0."""
    group = list(group or [])
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    err = a - p
    wide = pred.groupBy(*group).agg(
        F.avg(F.abs(err)).alias("mean_absolute_error"),
        F.sum(err * err).alias("_ssr"),
        (F.var_pop(a) * F.count(F.lit(1))).alias("_sst"),
        F.sqrt(F.avg(err * err)).alias("root_mean_squared_error"),
    ).withColumn(
        "r2",
        F.when(F.col("_sst") > 0, 1 - F.col("_ssr") / F.col("_sst"))
        .when(F.col("_ssr") == 0, 1.0).otherwise(0.0),
    )
    return _long(wide, group, REGRESSION_METRICS)


def _long(wide: DataFrame, group: list[str], spec) -> DataFrame:
    return wide.select(*group, F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"),
                 F.lit(hib).alias("higher_is_better"))
        for name, hib in spec
    ])))


def evaluate(pred: DataFrame, task, group: list[str] | None = None) -> DataFrame:
    """The full metric set for the task."""
    from ..config import Task

    if task is Task.CLASSIFICATION:
        return classification_metrics(pred, group)
    return regression_metrics(pred, group)


#: Predictions without which a task's metrics say nothing (R2 needs two).
LEAST_PREDICTIONS = {"classification": 1, "regression": 2}


def collect_metrics(metrics: DataFrame, rows: int, task) -> list[dict]:
    """The metric rows as dicts in order of name; too few predictions or
    metrics without a finite value are one error that names them all."""
    least = LEAST_PREDICTIONS[task.value]
    if rows < least:
        raise TrainingError(f"{task.value} metrics need {least} or more predictions; there are {rows}.")
    held = sorted((r.asDict() for r in metrics.collect()), key=lambda r: r["metric"])
    undefined = [r["metric"] for r in held if r["value"] is None or not math.isfinite(r["value"])]
    if undefined:
        raise TrainingError(f"No finite value of {', '.join(undefined)}.")
    return [{"name": r["metric"], "value": float(r["value"]), "higher_is_better": bool(r["higher_is_better"])}
            for r in held]
