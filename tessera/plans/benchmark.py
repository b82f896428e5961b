"""Holdout leaderboard (B1-B7): several classifiers on one shared split."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..config import (BenchmarkError, BenchmarkFailedError, ConfigurationError, FeatureOverrides, ForestConfig,
                      PreprocessingConfig, SplitConfig, Task, TrainingFailedError)
from ..functions.digest import table_fingerprint
from ..operators import estimators as E
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import ranking as RK
from ..operators import split as T
from ..session import fit_parallelism
from .registry import SCHEMA_VERSION, Registry, new_id, now
from .train import TrainingConfig, TrainingResult, keyed_table, train


@dataclass
class BenchmarkConfig:
    estimators: tuple[str, ...] = E.DEFAULT_CLASSIFIERS
    primary_metric: str = "balanced_accuracy"
    split: SplitConfig = field(default_factory=SplitConfig)
    preprocessing: PreprocessingConfig = field(default_factory=PreprocessingConfig)
    overrides: FeatureOverrides = field(default_factory=FeatureOverrides)
    forest: ForestConfig = field(default_factory=ForestConfig)

    def __post_init__(self) -> None:
        if len(self.estimators) < 2 or len(set(self.estimators)) != len(self.estimators):
            raise ConfigurationError("A benchmark needs at least two distinct estimators.")
        for name in self.estimators:
            E.check_estimator(name, Task.CLASSIFICATION)
        if self.primary_metric not in dict(M.CLASSIFICATION_METRICS):
            raise ConfigurationError(f"Unknown classification metric {self.primary_metric!r}.")


@dataclass
class BenchmarkResult:
    record: dict
    leaderboard: DataFrame
    runs: list[dict]
    models: dict[str, E.FittedModel]

    @property
    def winner(self) -> str | None:
        """Rank-one estimator."""
        for e in self.record["entries"]:
            if e["rank"] == 1:
                return e["estimator"]
        return None


def benchmark(df: DataFrame, config: BenchmarkConfig, *, target: str, key: list[str] | None = None,
              registry: Registry | None = None, source: str = "", parallelism: int | None = None) -> BenchmarkResult:
    """B1: profile and split once (cached), fit every estimator on it."""
    spark = df.sparkSession
    benchmark_id, started = new_id(), now()
    fingerprint = table_fingerprint(df)
    profile = P.profile_dataset(df, target)
    df, key, _ = keyed_table(df, target, key)
    split = T.split_dataset(df, target=target, key=key, task=Task.CLASSIFICATION, config=config.split)
    split.frame = split.frame.coalesce(E.fit_partitions(split.rows)).persist(StorageLevel.MEMORY_AND_DISK)
    split.partition_sha256()  # once, before the fits share it
    runs, models, durations = [], {}, {}

    def attempt(name: str):
        t0 = time.perf_counter()
        try:
            result: TrainingResult = train(
                df, TrainingConfig(Task.CLASSIFICATION, name, config.split, config.preprocessing,
                                   config.overrides, config.forest), target=target, key=key,
                registry=registry, source=source, fingerprint=fingerprint, profile=profile, split=split)
            return result.record, result.model, time.perf_counter() - t0
        except TrainingFailedError as error:
            return error.record, None, time.perf_counter() - t0

    try:
        # Estimators share the persisted split; their fits run side by side.
        with ThreadPoolExecutor(max_workers=max(1, min(fit_parallelism(spark, parallelism), len(config.estimators)))) as pool:
            outcomes = list(pool.map(attempt, config.estimators))
        for name, (record, model, seconds) in zip(config.estimators, outcomes):
            if model is not None:
                models[name] = model
            durations[record["run_id"]] = round(max(0.0, seconds), 6)
            runs.append(record)
    finally:
        split.frame.unpersist()
    entries = []
    for r in runs:
        value, hib = None, None
        for m in r["metrics"] or []:
            if m["name"] == config.primary_metric:
                value, hib = m["value"], m["higher_is_better"]
        if r["status"] == "succeeded" and value is None:
            raise BenchmarkError(f"Run {r['run_id']} did not record metric {config.primary_metric!r}.")
        entries.append((r["configuration"]["estimator"], r["run_id"], r["status"], value,
                        True if hib is None else hib, durations[r["run_id"]], r["failure"]))
    table = spark.createDataFrame(
        entries,
        "estimator string, run_id string, status string, value double, higher_is_better boolean, "
        "duration_seconds double, failure struct<error_type:string,message:string>")
    board = RK.leaderboard_rank(table)
    ranked = {r["run_id"]: r["rank"] for r in board.collect()}
    status = RK.status_of(table).first()["status"]
    ok = [r for r in runs if r["status"] == "succeeded"]
    record = {
        "schema_version": SCHEMA_VERSION, "benchmark_id": benchmark_id, "status": status,
        "started_at": started, "completed_at": now(), "primary_metric": config.primary_metric,
        "dataset": (ok[0] if ok else runs[0])["dataset"], "split": ok[0]["split"] if ok else None,
        "higher_is_better": next((e[4] for e in entries if e[2] == "succeeded"), True),
        "entries": [
            {"estimator": e[0], "run_id": e[1], "status": e[2], "duration_seconds": e[5],
             "rank": ranked.get(e[1]), "primary_metric_value": e[3] if e[2] == "succeeded" else None,
             "failure": e[6]}
            for e in entries
        ],
    }
    if registry is not None:
        registry.write("benchmarks", record)
    if status == "failed":
        raise BenchmarkFailedError(f"Benchmark {benchmark_id} failed: every estimator failed.", benchmark_id)
    return BenchmarkResult(record, board, runs, models)
