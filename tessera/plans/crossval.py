"""Stratified k-fold leaderboard.

The fold column is computed once and the tagged table persisted; each
(estimator, fold) cell learns its preprocessing statistics from the other
folds only, fits, and scores its validation fold.  All validation
predictions are unioned and every fold metric comes from one grouped
metric query.
"""

from __future__ import annotations

import logging
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    BenchmarkFailedError,
    PreprocessingError,
    ConfigurationError,
    FeatureOverrides,
    FoldConfig,
    ForestConfig,
    Imputation,
    PreprocessingConfig,
    Task,
)
from ..functions.columns import compact_message
from ..functions.digest import table_fingerprint
from ..operators import estimators as E
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import ranking as RK
from ..operators import split as T
from ..session import fit_parallelism
from .registry import SCHEMA_VERSION, Registry, new_id, now
from .train import expected_failure, keyed_table

log = logging.getLogger(__name__)


@dataclass
class CrossValidationConfig:
    estimators: tuple[str, ...] = E.DEFAULT_CLASSIFIERS
    primary_metric: str = "balanced_accuracy"
    folds: FoldConfig = field(default_factory=FoldConfig)
    preprocessing: PreprocessingConfig = field(default_factory=PreprocessingConfig)
    overrides: FeatureOverrides = field(default_factory=FeatureOverrides)
    forest: ForestConfig = field(default_factory=ForestConfig)

    def __post_init__(self) -> None:
        if len(self.estimators) < 2 or len(set(self.estimators)) != len(self.estimators):
            raise ConfigurationError("Cross-validation needs at least two distinct estimators.")
        for name in self.estimators:
            E.check_estimator(name, Task.CLASSIFICATION)
        if self.primary_metric not in dict(M.CLASSIFICATION_METRICS):
            raise ConfigurationError(f"Unknown classification metric {self.primary_metric!r}.")


def configuration_record(cfg: CrossValidationConfig) -> dict:
    """What a refit needs to build the same pipeline again."""
    return {
        "numeric_imputation": cfg.preprocessing.numeric_imputation.value,
        "scale_numeric": cfg.preprocessing.scale_numeric,
        "categorical_fill_value": cfg.preprocessing.categorical_fill_value,
        "numeric_overrides": list(cfg.overrides.numeric),
        "categorical_overrides": list(cfg.overrides.categorical),
        "fold_count": cfg.folds.fold_count,
        "random_seed": cfg.folds.random_seed,
        "forest": asdict(cfg.forest),
    }


def configuration_from(record: dict) -> tuple[PreprocessingConfig, FeatureOverrides, ForestConfig]:
    """The settings of a stored ``configuration``."""
    return (PreprocessingConfig(Imputation(record["numeric_imputation"]), record["scale_numeric"],
                                record["categorical_fill_value"]),
            FeatureOverrides(tuple(record["numeric_overrides"]), tuple(record["categorical_overrides"])),
            ForestConfig(**record["forest"]))


@dataclass
class CrossValidationResult:
    record: dict
    fold_metrics: DataFrame
    leaderboard: DataFrame

    @property
    def winner(self) -> str | None:
        """Rank-one estimator (no fitted model is kept)."""
        return next((e["estimator"] for e in self.record["entries"] if e["rank"] == 1), None)


def _fold_cell(folded: DataFrame, fold: int, name: str, target: str, key: list[str],
               cfg: CrossValidationConfig, stats: FE.FeatureStats, violation: str | None) -> DataFrame:
    """Fit one estimator on the other folds and score fold ``fold``."""
    if violation:
        raise PreprocessingError(violation)
    train_rows = F.col("fold") != fold
    fitted = E.fit_estimator(folded.filter(train_rows).drop("fold"), stats, target=target,
                             estimator=name, task=Task.CLASSIFICATION, seed=cfg.folds.random_seed, key=key,
                             forest_config=cfg.forest)
    return E.predict(fitted, folded.filter(~train_rows), [*key, target]).select(
        F.lit(name).alias("estimator"), F.lit(fold).alias("fold"),
        F.col(target).alias("actual"), F.col("prediction").alias("predicted"))


def cross_validate(df: DataFrame, cfg: CrossValidationConfig, *, target: str, key: list[str] | None = None,
                   registry: Registry | None = None, source: str = "",
                   parallelism: int | None = None) -> CrossValidationResult:
    """Every estimator x fold; a failing fold stops that estimator."""
    spark = df.sparkSession
    benchmark_id, started = new_id(), now()
    k = cfg.folds.fold_count
    base = df
    df, key, features = keyed_table(df, target, key)
    # Sized by the data, not by spark.sql.shuffle.partitions: a narrow
    # coalesce keeps every fit and the metric job off thousands of tiny tasks.
    folded = T.assign_folds(df, target=target, key=key, config=cfg.folds).coalesce(
        E.fit_partitions(df.count())).persist(StorageLevel.MEMORY_AND_DISK)
    attempts: list = []
    dummy_cells: list = []
    try:
        t_phase = time.perf_counter()

        def phase(name: str) -> None:
            nonlocal t_phase
            log.info("cross_validate %s: %.1fs", name, time.perf_counter() - t_phase)
            t_phase = time.perf_counter()

        snapshots = T.fold_snapshots(folded, key, k)
        snaps = [r.asDict() for r in snapshots.orderBy("fold_number").collect()]
        plan_digest = T.fold_plan_digest(snapshots).first()["fold_plan_sha256"]
        phase("folds and digests")
        profile = P.profile_dataset(base, target)
        fingerprint = table_fingerprint(base)
        phase("profile and fingerprint")
        # Roles, checks and preprocessing statistics of every fold, computed
        # once and shared by all estimators.
        schema = FE.infer_feature_schema(df, features, cfg.overrides)
        violations = FE.fold_input_violations(folded, schema, cfg.preprocessing, k)
        fold_stats = FE.fit_fold_feature_stats(folded, schema, cfg.preprocessing, k)
        phase("fold statistics")
        # Cells are independent: fit them concurrently from a small driver
        # thread pool (Spark schedules the jobs side by side), then keep, per
        # estimator, the folds before its first failure.
        def run_cell(name: str, fold: int):
            t0 = time.perf_counter()
            try:
                cell = _fold_cell(folded, fold, name, target, key, cfg, fold_stats[fold],
                                  violations[fold]).persist(StorageLevel.MEMORY_AND_DISK)
                cell.count()
                return cell, None, time.perf_counter() - t0
            except Exception as error:  # C6: record where it failed
                if not expected_failure(error):
                    raise
                return None, {"error_type": type(error).__name__, "message": compact_message(error)}, \
                    time.perf_counter() - t0

        outcomes = {}
        if E.DUMMY_CLASSIFIER in cfg.estimators and not any(violations.values()):
            # The prior dummy needs no per-fold model: every fold's majority
            # class and predictions come from one class-count query.
            t0 = time.perf_counter()
            every_fold = E.dummy_fold_predictions(folded, target, k).select(
                F.lit(E.DUMMY_CLASSIFIER).alias("estimator"), "fold", "actual", "predicted"
            ).persist(StorageLevel.MEMORY_AND_DISK)
            every_fold.count()
            share = (time.perf_counter() - t0) / k
            dummy_cells.append(every_fold)
            for fold in range(1, k + 1):
                outcomes[(E.DUMMY_CLASSIFIER, fold)] = (every_fold.filter(F.col("fold") == fold), None, share)
        pending = [(name, fold) for name in cfg.estimators for fold in range(1, k + 1)
                   if (name, fold) not in outcomes]
        with ThreadPoolExecutor(max_workers=max(1, min(fit_parallelism(spark, parallelism), len(pending) or 1))) as pool:
            futures = {cell: pool.submit(run_cell, *cell) for cell in pending}
            outcomes.update({cell: f.result() for cell, f in futures.items()})
        for name in cfg.estimators:
            cells, failure, duration = [], None, 0.0
            for fold in range(1, k + 1):
                cell, error, seconds = outcomes[(name, fold)]
                duration += seconds
                if failure is None and error is None:
                    cells.append(cell)
                else:
                    if failure is None:
                        failure = (fold, snaps[fold - 1]["partition_sha256"], error)
                    if cell is not None and name != E.DUMMY_CLASSIFIER:
                        cell.unpersist()
            attempts.append((name, cells, failure, duration))
        phase("fits")
        schema = "estimator string, fold int, actual string, predicted string"
        all_cells = [c.select(F.col("estimator"), F.col("fold").cast("int"), F.col("actual").cast("string"),
                              F.col("predicted").cast("string")) for _, cells, _, _ in attempts for c in cells]
        predictions = spark.createDataFrame([], schema)
        for c in all_cells:
            predictions = predictions.unionByName(c)
        # All folds of all estimators in one grouped metric query.
        fold_metrics = M.classification_metrics(predictions, ["estimator", "fold"]).persist()
        per_fold = fold_metrics.collect()
        phase("fold metrics")
        summaries = RK.fold_summaries(fold_metrics)
        summary_rows = summaries.collect()
        phase("summaries")
        failed = {name for name, _, failure, _ in attempts if failure is not None}
        ok_summaries = summaries.filter(~F.col("estimator").isin(*failed)) if failed else summaries
        board = RK.stability_rank(ok_summaries, cfg.primary_metric)
        ranks = {r["estimator"]: r for r in board.collect()}
        phase("metrics and ranking")
    finally:
        folded.unpersist()
        for _, cells, _, _ in attempts:
            for c in cells:
                c.unpersist()
        for c in dummy_cells:
            c.unpersist()
    entries = []
    for name, cells, failure, duration in attempts:
        mine = [s for s in summary_rows if s["estimator"] == name]
        entry_metrics = [] if failure else [
            {"name": s["metric"], "fold_values": list(s["fold_values"]), "mean": s["mean"],
             "standard_deviation": s["standard_deviation"], "higher_is_better": s["higher_is_better"]}
            for s in sorted(mine, key=lambda s: s["metric"])]
        rank = ranks.get(name)
        entries.append({
            "estimator": name, "parameters": E.static_parameters(name, cfg.folds.random_seed, cfg.forest), "status": "failed" if failure else "succeeded",
            "rank": rank["rank"] if rank else None,
            "primary_metric_mean": rank["mean"] if rank else None,
            "primary_metric_standard_deviation": rank["standard_deviation"] if rank else None,
            "metrics": entry_metrics, "duration_seconds": round(duration, 6),
            "failure_fold": failure[0] if failure else None,
            "failure_partition_sha256": failure[1] if failure else None,
            "failure": failure[2] if failure else None,
        })
    ok = sum(1 for e in entries if e["status"] == "succeeded")
    status = "failed" if ok == 0 else "succeeded" if ok == len(entries) else "partial"
    record = {
        "schema_version": SCHEMA_VERSION, "benchmark_id": benchmark_id, "status": status,
        "started_at": started, "completed_at": now(), "primary_metric": cfg.primary_metric,
        "random_seed": cfg.folds.random_seed, "configuration": configuration_record(cfg),
        "dataset": {"source": source, "fingerprint": fingerprint, "row_count": profile.rows,
                    "column_count": len(base.columns), "target": target},
        "fold_plan_sha256": plan_digest, "folds": snaps, "warnings": profile.warnings, "entries": entries,
    }
    if registry is not None:
        registry.write("cv_benchmarks", record)
    if status == "failed":
        raise BenchmarkFailedError(f"Cross-validation {benchmark_id} failed: every estimator failed.",
                                   benchmark_id)
    fm = spark.createDataFrame(per_fold, fold_metrics.schema) if per_fold else fold_metrics
    fold_metrics.unpersist()
    return CrossValidationResult(record, fm, board)
