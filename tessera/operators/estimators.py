"""The five baseline estimators (E1-E8) as fitted ``pyspark.ml`` pipelines.

Every fitted model is a ``PipelineModel`` whose ``transform`` adds a
``prediction`` column in the original label space and type, so models
persist with Spark's own writer and score on executors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.ml.util import Identifiable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConfigurationError, ForestConfig, Task, TrainingError
from ..session import checkpoint_dir
from . import forest, linear
from .dictionary import CategoryWeights, category_positions, feature_positions, write_weights
from .features import FEATURES_COL, FeatureStats, preprocessing_stages

# Estimator names and the task each one serves.
DUMMY_CLASSIFIER = "dummy-classifier"
LOGISTIC_REGRESSION = "logistic-regression"
RANDOM_FOREST_CLASSIFIER = "random-forest-classifier"
RIDGE_REGRESSION = "ridge-regression"
RANDOM_FOREST_REGRESSOR = "random-forest-regressor"
ESTIMATOR_TASKS = {
    DUMMY_CLASSIFIER: Task.CLASSIFICATION,
    LOGISTIC_REGRESSION: Task.CLASSIFICATION,
    RANDOM_FOREST_CLASSIFIER: Task.CLASSIFICATION,
    RIDGE_REGRESSION: Task.REGRESSION,
    RANDOM_FOREST_REGRESSOR: Task.REGRESSION,
}
DEFAULT_CLASSIFIERS = (DUMMY_CLASSIFIER, LOGISTIC_REGRESSION, RANDOM_FOREST_CLASSIFIER)

#: Spark's normal-equation solver takes at most so many encoded columns.
NORMAL_SOLVER_COLUMNS = 4096
RIDGE_ALPHA = 1.0
LOGISTIC_C = 1.0
FIT_PARTITIONS_MIN = 8
ROWS_PER_FIT_PARTITION = 2_000_000
#: Categories of a wide column with more than one in so many rows are columns of the fit.
GROUP_SHARE = 64


def static_parameters(name: str, seed: int, forest: ForestConfig = ForestConfig()) -> list[dict]:
    """The estimator's configured (data-independent) parameters."""
    size = [("max_bins", forest.max_bins), ("max_depth", forest.max_depth), ("n_estimators", forest.trees)]
    table = {
        DUMMY_CLASSIFIER: [("random_state", seed), ("strategy", "prior")],
        LOGISTIC_REGRESSION: [("C", LOGISTIC_C), ("max_iter", 1000), ("random_state", seed)],
        RANDOM_FOREST_CLASSIFIER: [*size, ("max_features", "sqrt"), ("random_state", seed)],
        RIDGE_REGRESSION: [("alpha", RIDGE_ALPHA)],
        RANDOM_FOREST_REGRESSOR: [*size, ("max_features", "all"), ("random_state", seed)],
    }
    return [{"name": k, "value": str(v)} for k, v in sorted(table[name])]


def check_estimator(name: str, task: Task) -> None:
    """Known name and matching task."""
    if name not in ESTIMATOR_TASKS:
        raise ConfigurationError(f"Unknown estimator {name!r}.")
    if ESTIMATOR_TASKS[name] is not task:
        raise ConfigurationError(
            f"Estimator {name!r} supports {ESTIMATOR_TASKS[name].value}, not {task.value}."
        )


@dataclass
class FittedModel:
    model: PipelineModel
    estimator: str
    parameters: list[tuple[str, str]]
    labels: list[str] | None = None
    warnings: list[str] = field(default_factory=list)


def _sql_literal(value, type_name: str) -> str:
    text = str(value).replace("'", "''")
    return f"CAST('{text}' AS {type_name})"


def majority_label(train: DataFrame, target: str):
    """Most frequent class; ties go to the smallest label (top-1, no window)."""
    row = (
        train.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.col("_n").desc(), F.col(target).asc()).limit(1).first()
    )
    return row[target]


def fit_partitions(rows: int) -> int:
    """Partition count for a fit: a function of the row count only, so a run
    is reproducible on any cluster, and it grows with the data."""
    return max(FIT_PARTITIONS_MIN, -(-rows // ROWS_PER_FIT_PARTITION))


def deterministic_layout(df: DataFrame, key: list[str], partitions: int) -> DataFrame:
    """Fixed row layout before fitting: forests depend on partitioning."""
    return df.repartition(partitions, *key).sortWithinPartitions(*key)


def _params(est) -> list[tuple[str, str]]:
    """Sorted explicit parameters as text."""
    return sorted((p.name, str(v)) for p, v in est.extractParamMap().items()
                  if p.name not in ("featuresCol", "labelCol", "predictionCol", "probabilityCol",
                                    "rawPredictionCol"))


def _linear_model(spark: SparkSession, fit: linear.LinearFit, classes: int | None = None):
    """The Spark model that scores with the fitted coefficients."""
    sc = spark.sparkContext
    java = lambda v: _py2java(sc, v)
    if classes is None:
        package, weights = sc._jvm.org.apache.spark.ml.regression, java(DenseVector(fit.weights[0]))
        return LinearRegressionModel(package.LinearRegressionModel(
            _uid("linear"), weights, float(fit.intercept[0]))).setFeaturesCol(FEATURES_COL)
    outputs, width = fit.weights.shape
    weights = java(DenseMatrix(outputs, width, np.ascontiguousarray(fit.weights).ravel(), isTransposed=True))
    model = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        _uid("logistic"), weights, java(DenseVector(fit.intercept)), classes, outputs > 1)
    return LogisticRegressionModel(model).setFeaturesCol(FEATURES_COL)


def _frequent(stats: FeatureStats, spark: SparkSession) -> list[str]:
    """Values of the one wide column with more than one in ``GROUP_SHARE`` of
    the rows: they get columns of their own, the others share blocks."""
    table = stats.dictionary.table(spark).where((F.col("column_name") == stats.wide[0]) & F.col(stats.rank).isNotNull())
    top = table.where(F.col("n") * GROUP_SHARE > table.agg(F.sum("n")).scalar()).select("value")
    return sorted(r["value"] for r in top.collect())


def _fit_blocks(rows: DataFrame, stats: FeatureStats, label: Column, outputs: int) -> tuple[DataFrame, list[str] | None]:
    """The encoded training rows in blocks, wide columns included.  One wide
    column makes groups of rows, except for its frequent values, also returned;
    several (None) become positions in the encoded vector."""
    if len(stats.wide) == 1:
        frequent = _frequent(stats, rows.sparkSession)
        value = F.col(f"`_cat__{stats.wide[0]}`")
        place = F.array_position(F.array(*[F.lit(v) for v in frequent]).cast("array<string>"), value)
        ones = F.when(place > 0, F.array(place - 1 + stats.list_width)).otherwise(F.array().cast("array<bigint>"))
        unknowns = outputs * (stats.list_width + len(frequent) + 1)
        blocks = linear.grouped_blocks(rows, FEATURES_COL, label, F.when(place == 0, value), ones, unknowns, outputs)
        return blocks.persist(StorageLevel.MEMORY_AND_DISK), frequent
    if stats.wide:
        rows = category_positions(rows, stats.dictionary, stats.wide, stats.rank, stats.list_width)
    return linear.row_blocks(rows, FEATURES_COL, label, "_wide" if stats.wide else None).persist(
        StorageLevel.MEMORY_AND_DISK), None


def _fit_width(stats: FeatureStats, frequent: list[str] | None) -> int:
    return stats.width if frequent is None else stats.list_width + len(frequent)


def _linear_stages(spark: SparkSession, fit: linear.LinearFit, stats: FeatureStats, output: str, blocks: DataFrame,
                   frequent: list[str] | None, classes: int | None = None) -> list:
    """The stages that score a linear fit.  The weights of wide columns become
    a table by value; those of a single one never leave the tasks."""
    n = stats.list_width
    listed = replace(fit, weights=fit.weights[:, :n])
    if not stats.wide:
        return [_linear_model(spark, listed, classes).setPredictionCol(output)]
    path = f"{checkpoint_dir(spark)}/tessera-weights/{uuid.uuid4().hex}"
    rest = fit.weights[:, n:].T  # position x outputs
    both = classes is not None and rest.shape[1] == 1  # two classes have opposite scores
    scores = rest.shape[1] + both
    if frequent is not None:
        counts = stats.dictionary.table(spark).where(F.col("column_name") == stats.wide[0]).select("value", "n")
        own = spark.createDataFrame([(v, [float(w) for w in ws]) for v, ws in zip(frequent, rest)],
                                    "value string, weights array<double>").join(counts, "value")
        found = linear.group_weights(blocks, fit, c=None if classes is None else LOGISTIC_C, alpha=RIDGE_ALPHA)
        weights = F.array(-F.col("weights")[0], F.col("weights")[0]) if both else F.col("weights")
        found.unionByName(own).select(F.lit(stats.wide[0]).alias("column_name"), "value", "n",
                                      weights.alias("weights")).write.parquet(path)
    else:
        if both:
            rest = np.concatenate([-rest, rest], axis=1)
        write_weights(feature_positions(spark, stats.dictionary, stats.wide, stats.rank, n), rest, n, path)
    base = "_base_score" if classes is None else "rawPrediction"
    model = _linear_model(spark, listed, classes).setPredictionCol("_base_score")
    return [model, CategoryWeights(baseCol=base, outputCol=output, columns=list(stats.wide), table=path, scores=scores)]


def _uid(kind: str) -> str:
    return f"{kind}_{Identifiable().uid.rsplit('_', 1)[-1]}"


def _certificate(fit: linear.LinearFit, name: str) -> tuple[list[tuple[str, str]], list[str]]:
    """What a linear fit records about its optimum, and its warnings."""
    facts = [("converged", str(fit.converged).lower()), ("largest_gradient", f"{fit.gradient:.3e}"),
             ("passes", str(fit.passes)), ("steps", str(fit.steps))]
    warnings = [] if fit.converged else [
        f"{name} did not converge: the largest gradient component is {fit.gradient:.3e} after {fit.steps} steps."]
    return facts, warnings


def fit_estimator(
    train: DataFrame,
    stats: FeatureStats,
    *,
    target: str,
    estimator: str,
    task: Task,
    seed: int,
    key: list[str],
    forest_config: ForestConfig = ForestConfig(),
) -> FittedModel:
    """Fit preprocessing (from ``stats``) + estimator on ``train`` rows."""
    size = {"numTrees": forest_config.trees, "maxDepth": forest_config.max_depth,
            "maxBins": forest_config.max_bins, "maxMemoryInMB": forest_config.memory_mb}
    check_estimator(estimator, task)
    target_type = train.schema[target].dataType.simpleString()
    pre = preprocessing_stages(stats)
    if estimator == DUMMY_CLASSIFIER:
        label = majority_label(train, target)
        final = SQLTransformer(statement=(
            f"SELECT *, {_sql_literal(label, target_type)} AS prediction FROM __THIS__"))
        model = Pipeline(stages=pre + [final]).fit(train.limit(1))
        return FittedModel(model, estimator, [("strategy", "prior"), ("random_state", str(seed))],
                           [str(label)])
    rows = stats.training_rows or train.count()
    is_forest = estimator in (RANDOM_FOREST_CLASSIFIER, RANDOM_FOREST_REGRESSOR)
    if is_forest and stats.wide:
        raise TrainingError(
            "Forests take categorical columns of limited size; "
            + ", ".join(repr(c) for c in stats.wide) + " hold more values. Use a linear model or engineer them first.")
    # Forests depend on the row layout, so they get a fixed one (a shuffle);
    # the linear models depend on it only through summation order.
    partitions = fit_partitions(rows)
    # Forests get a fixed layout (a shuffle); other fits only a narrow
    # coalesce to a data-sized partition count.
    laid_out = deterministic_layout(train, key, partitions) if is_forest else train.coalesce(partitions)
    layout = [("fit_partitions", str(partitions))] if is_forest else []
    pre_model = Pipeline(stages=pre).fit(train.limit(1))  # literals + one-hot sizes only
    if task is Task.CLASSIFICATION:
        # Labels do not depend on row order: index them from the rows as they are.
        label_model = StringIndexer(inputCol=target, outputCol="_label_idx",
                                    stringOrderType="alphabetAsc").fit(train.select(target))
        labels = list(label_model.labels)
        prepared = label_model.transform(pre_model.transform(laid_out))
        warnings: list[str] = []
        if estimator == LOGISTIC_REGRESSION:
            if len(labels) < 2:
                raise TrainingError("Logistic regression needs training rows of two classes at least.")
            blocks, frequent = _fit_blocks(prepared, stats, F.col("_label_idx"), 1 if len(labels) == 2 else len(labels))
            try:
                fit = linear.fit_logistic(blocks, rows, len(labels), _fit_width(stats, frequent), LOGISTIC_C)
                fitted = _linear_stages(train.sparkSession, fit, stats, "_prediction_idx", blocks, frequent, len(labels))
            finally:
                blocks.unpersist()
            facts, warnings = _certificate(fit, estimator)
            parameters = sorted([("C", str(LOGISTIC_C)), ("solver", "newton"), *facts])
        else:
            est = RandomForestClassifier(
                featuresCol=FEATURES_COL, labelCol="_label_idx", predictionCol="_prediction_idx",
                featureSubsetStrategy="sqrt", seed=seed, **size,
            )
            # Only what the fit reads is kept for its passes.
            prepared = prepared.select(FEATURES_COL, "_label_idx").persist(StorageLevel.MEMORY_AND_DISK)
            try:  # iterative fits pass over the prepared rows many times
                fitted = [forest.fit_classifier(est, prepared, len(labels))]
            finally:
                prepared.unpersist()
            parameters = _params(est) + layout
        back = IndexToString(inputCol="_prediction_idx", outputCol="_pred_label", labels=labels)
        final = SQLTransformer(statement=(
            f"SELECT *, CAST(_pred_label AS {target_type}) AS prediction FROM __THIS__"))
        stages = list(pre_model.stages) + [*fitted, back, final]
        return FittedModel(PipelineModel(stages), estimator, parameters, labels, warnings)
    if estimator == RIDGE_REGRESSION and (stats.wide or stats.width > NORMAL_SOLVER_COLUMNS):
        # Beyond the normal solver's width: the same objective, matrix-free.
        blocks, frequent = _fit_blocks(pre_model.transform(laid_out), stats, F.col(target), 1)
        try:
            fit = linear.fit_ridge(blocks, rows, _fit_width(stats, frequent), RIDGE_ALPHA)
            fitted = _linear_stages(train.sparkSession, fit, stats, "prediction", blocks, frequent)
        finally:
            blocks.unpersist()
        facts, warnings = _certificate(fit, estimator)
        return FittedModel(PipelineModel(list(pre_model.stages) + fitted), estimator,
                           sorted([("alpha", str(RIDGE_ALPHA)), ("solver", "conjugate-gradients"), *facts]),
                           warnings=warnings)
    prepared = pre_model.transform(laid_out).select(FEATURES_COL, F.col(target).cast("double").alias("_y")).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        if estimator == RIDGE_REGRESSION:
            # Spark's normal-equation solver scales the penalty by sd(y): this
            # regParam reproduces ridge with penalty alpha and a free intercept.
            y_sd = prepared.agg(F.stddev_pop("_y")).first()[0] or 0.0
            est = LinearRegression(
                featuresCol=FEATURES_COL, labelCol="_y", predictionCol="prediction",
                solver="normal", regParam=RIDGE_ALPHA * y_sd / rows if y_sd else 0.0,
                elasticNetParam=0.0, standardization=False,
            )
        else:
            est = RandomForestRegressor(
                featuresCol=FEATURES_COL, labelCol="_y", predictionCol="prediction",
                featureSubsetStrategy="all", seed=seed, **size,
            )
        fitted = est.fit(prepared)
    finally:
        prepared.unpersist()
    return FittedModel(PipelineModel(list(pre_model.stages) + [fitted]), estimator, _params(est) + layout)


def dummy_fold_predictions(folded: DataFrame, target: str, fold_count: int) -> DataFrame:
    """E1 + C3: prior-dummy predictions for every fold in one query.

    Every fold's majority class comes from one class-count table.

    Train counts of fold k = class total - class count in fold k; the k
    majorities (ties to the smallest label) join back as a k-row broadcast.
    """
    cc = folded.groupBy("fold", target).agg(F.count(F.lit(1)).alias("_n"))
    tot = cc.groupBy(target).agg(F.sum("_n").alias("_t"))
    ks = tot.select(target, "_t", F.explode(F.sequence(F.lit(1), F.lit(fold_count))).alias("fold"))
    train = ks.join(cc, ["fold", target], "left").withColumn("_tn", F.col("_t") - F.coalesce(F.col("_n"), F.lit(0)))
    maj = train.groupBy("fold").agg(
        F.min(F.struct((-F.col("_tn")).alias("n"), F.col(target).alias("label"))).alias("top")).select(
        "fold", F.col("top.label").alias("predicted"))
    return folded.select("fold", F.col(target).alias("actual")).join(F.broadcast(maj), "fold")


def build_model_pipeline(stats: FeatureStats, estimator) -> Pipeline:
    """an unfitted pipeline of the learned preprocessing and a copy of
    any ``pyspark.ml`` estimator reading the ``features`` column."""
    from pyspark.ml import Estimator

    if not isinstance(estimator, Estimator):
        raise ConfigurationError("Estimator must be a pyspark.ml Estimator.")
    est = estimator.copy()
    if est.hasParam("featuresCol"):
        est = est.copy({est.getParam("featuresCol"): FEATURES_COL})
    return Pipeline(stages=preprocessing_stages(stats) + [est])


def predict(model: FittedModel | PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Score ``df``; returns ``keep`` columns + ``prediction``."""
    pm = model.model if isinstance(model, FittedModel) else model
    out = pm.transform(df)
    if "prediction" not in out.columns:
        raise TrainingError("Fitted pipeline produced no prediction column.")
    return out.select(*keep, "prediction")
