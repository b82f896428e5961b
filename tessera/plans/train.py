"""One training run (R1-R4): profile -> split -> roles -> fit -> predict -> metrics -> record."""

from __future__ import annotations

import platform
from dataclasses import dataclass, field

import pyspark
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    FeatureOverrides,
    ForestConfig,
    PreprocessingConfig,
    SplitConfig,
    Task,
    TesseraError,
    TrainingError,
    TrainingFailedError,
)
from ..functions.columns import compact_message
from ..functions.digest import table_fingerprint
from ..functions.frames import ROW_KEY, with_row_key
from ..operators import estimators as E
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import split as T
from .registry import SCHEMA_VERSION, Registry, new_id, now


@dataclass
class TrainingConfig:
    task: Task
    estimator: str
    split: SplitConfig = field(default_factory=SplitConfig)
    preprocessing: PreprocessingConfig = field(default_factory=PreprocessingConfig)
    overrides: FeatureOverrides = field(default_factory=FeatureOverrides)
    forest: ForestConfig = field(default_factory=ForestConfig)


@dataclass
class TrainingResult:
    record: dict
    model: E.FittedModel | None
    predictions: DataFrame | None
    stats: FE.FeatureStats | None


def environment() -> dict:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__}


def configuration_record(cfg: TrainingConfig, parameters: list[tuple[str, str]]) -> dict:
    return {
        "task": cfg.task.value,
        "estimator": cfg.estimator,
        "validation_fraction": float(cfg.split.validation_fraction),
        "random_seed": cfg.split.random_seed,
        "stratify_requested": cfg.split.stratify,
        "numeric_imputation": cfg.preprocessing.numeric_imputation.value,
        "scale_numeric": cfg.preprocessing.scale_numeric,
        "categorical_fill_value": cfg.preprocessing.categorical_fill_value,
        "numeric_overrides": list(cfg.overrides.numeric),
        "categorical_overrides": list(cfg.overrides.categorical),
        "estimator_parameters": [{"name": n, "value": v} for n, v in parameters],
    }


def dataset_record(df: DataFrame, target: str, source: str, fingerprint: str, rows: int) -> dict:
    return {"source": source, "fingerprint": fingerprint, "row_count": rows,
            "column_count": len(df.columns), "target": target}


def split_record(split: T.Split, digest: str) -> dict:
    return {"train_rows": split.train_rows, "validation_rows": split.validation_rows,
            "feature_count": split.feature_count, "stratified": split.stratified,
            "partition_sha256": digest}


INFRASTRUCTURE_SIGNS = ("ExecutorLost", "FetchFailed", "MetadataFetchFailed", "OutOfMemory", "SparkContext was shut down",
                        "ConnectException", "No space left", "Stage cancelled")


def expected_failure(error: BaseException) -> bool:
    """Errors recorded as failed runs: ours, bad values, and Spark job errors."""
    from pyspark.errors import PySparkException

    try:
        from py4j.protocol import Py4JJavaError
    except ImportError:  # pragma: no cover
        Py4JJavaError = ()  # type: ignore[assignment]
    if isinstance(error, Py4JJavaError) or isinstance(error, PySparkException):
        # A lost executor, fetch or memory failure says nothing about the model.
        return not any(sign in str(error) for sign in INFRASTRUCTURE_SIGNS)
    return isinstance(error, (TesseraError, ValueError, TypeError, ArithmeticError))


def keyed_table(df: DataFrame, target: str, key: list[str] | None):
    """(table, key, features): without a declared key a content-derived
    ``__row_key`` is added; it is never a feature."""
    if key:
        return df, list(key), [c for c in df.columns if c != target and c != ROW_KEY]
    return with_row_key(df), [ROW_KEY], [c for c in df.columns if c != target and c != ROW_KEY]


def merge_warnings(*groups) -> list[str]:
    """De-duplicated, order kept."""
    return list(dict.fromkeys(w for g in groups for w in g if str(w).strip()))


def _scored_rows(predictions: DataFrame, sp: T.Split) -> int:
    """The predictions' own row count, which must be the validation part's."""
    rows = predictions.count()
    if rows != sp.validation_rows:
        raise TrainingError(f"{rows} predictions for {sp.validation_rows} validation rows.")
    return rows


def train(
    df: DataFrame,
    cfg: TrainingConfig,
    *,
    target: str,
    key: list[str] | None = None,
    registry: Registry | None = None,
    source: str = "",
    fingerprint: str | None = None,
    profile: P.DatasetProfile | None = None,
    split: T.Split | None = None,
) -> TrainingResult:
    """A complete run.  Expected failures are recorded, then raised.

    ``profile``/``split`` may be passed in by a benchmark so they are
    computed once for all estimators.
    """
    E.check_estimator(cfg.estimator, cfg.task)
    run_id, started = new_id(), now()
    df, key, features = keyed_table(df, target, key)
    base = df.drop(ROW_KEY) if ROW_KEY in df.columns else df  # the data without the synthetic key
    fp = fingerprint or table_fingerprint(base)
    parameters: list[tuple[str, str]] = []
    split_rec = None
    prof_warnings: list[str] = []
    owned: list[DataFrame] = []
    try:
        prof = profile or P.profile_dataset(base, target)
        prof_warnings = prof.warnings
        if split is None:
            sp = T.split_dataset(df, target=target, key=key, task=cfg.task, config=cfg.split)
            # Reused by digest, checks, statistics, fit and scoring.
            partitions = E.fit_partitions(sp.rows)
            few = base._jdf.queryExecution().toRdd().getNumPartitions() < partitions  # the split keeps the input's
            sp.frame = (sp.frame.repartition(partitions) if few else sp.frame.coalesce(partitions)).persist(
                StorageLevel.MEMORY_AND_DISK)
            owned.append(sp.frame)
        else:
            sp = split
        split_rec = split_record(sp, sp.partition_sha256())
        schema = FE.infer_feature_schema(sp.frame, features, cfg.overrides)
        FE.validate_preprocessing_inputs(sp.frame, schema, cfg.preprocessing)
        stats = FE.fit_feature_stats(sp.frame, schema, cfg.preprocessing, where=F.col("part") == "train")
        fitted = E.fit_estimator(sp.train(), stats, target=target, estimator=cfg.estimator,
                                 task=cfg.task, seed=cfg.split.random_seed, key=key, forest_config=cfg.forest)
        parameters = fitted.parameters
        predictions = E.predict(fitted, sp.validation(), [*key, target]).select(
            *key, F.col(target).alias("actual"), F.col("prediction").alias("predicted"))
        metrics = M.collect_metrics(M.evaluate(predictions, cfg.task), _scored_rows(predictions, sp), cfg.task)
    except Exception as error:
        if not expected_failure(error):
            raise
        record = {
            "schema_version": SCHEMA_VERSION, "run_id": run_id, "status": "failed",
            "started_at": started, "completed_at": now(),
            "configuration": configuration_record(cfg, parameters),
            "dataset": dataset_record(base, target, source, fp, split_rec["train_rows"] + split_rec["validation_rows"]
                                      if split_rec else 0),
            "environment": environment(), "split": split_rec, "metrics": None,
            "warnings": merge_warnings(prof_warnings),
            "failure": {"error_type": type(error).__name__, "message": compact_message(error)},
        }
        if registry is not None:
            registry.write("runs", record)
        for frame in owned:
            frame.unpersist()
        raise TrainingFailedError(f"Training run {run_id} failed: {compact_message(error)}", run_id, record) from error
    record = {
        "schema_version": SCHEMA_VERSION, "run_id": run_id, "status": "succeeded",
        "started_at": started, "completed_at": now(),
        "configuration": configuration_record(cfg, parameters),
        "dataset": dataset_record(base, target, source, fp, sp.rows),
        "environment": environment(), "split": split_rec, "metrics": metrics,
        "warnings": merge_warnings(prof_warnings, fitted.warnings), "failure": None,
    }
    if registry is not None:
        registry.write("runs", record)
    for frame in owned:
        frame.unpersist()
    return TrainingResult(record, fitted, predictions, stats)
