"""Leaderboards, run comparison and audits over registry tables.

The windows here are global on purpose: their inputs hold one row per
estimator or run, never per data row.

Inputs are small registry DataFrames (one row per run / estimator / fold);
ranks are ``row_number`` windows over them.  Audits recompute a stored
result and return the disagreeing rows (empty = consistent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ComparisonError


def _directed(value: str = "value", hib: str = "higher_is_better"):
    return F.when(F.col(hib), -F.col(value)).otherwise(F.col(value))


def fold_summaries(per_fold: DataFrame) -> DataFrame:
    """C4: per (estimator, metric): fold values in fold order, mean, population sd."""
    return per_fold.groupBy("estimator", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("standard_deviation"),
        F.count(F.lit(1)).alias("fold_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("fold", "value"))), lambda s: s["value"]).alias(
            "fold_values"),
        F.first("higher_is_better").alias("higher_is_better"),
        F.countDistinct("higher_is_better").alias("_dirs"),
    )


def stability_rank(summaries: DataFrame, metric: str) -> DataFrame:
    """Rank by mean (in the metric's direction), then lower sd, then name."""
    primary = summaries.filter(F.col("metric") == metric)
    order = Window.orderBy(_directed("mean"), F.col("standard_deviation").asc(), F.col("estimator").asc())
    return primary.withColumn("rank", F.row_number().over(order)).select(
        "estimator", "mean", "standard_deviation", "higher_is_better", "rank")


def leaderboard_rank(entries: DataFrame) -> DataFrame:
    """B2 + B4: successful entries ranked by (value in direction, estimator,
    run_id); failed entries stay with a NULL rank."""
    ok = entries.filter(F.col("status") == "succeeded")
    order = Window.orderBy(_directed(), F.col("estimator").asc(), F.col("run_id").asc())
    ranked = ok.withColumn("rank", F.row_number().over(order)).select("run_id", "rank")
    return entries.join(ranked, "run_id", "left")


def status_of(entries: DataFrame) -> DataFrame:
    """Succeeded if all succeeded, partial if some, failed if none."""
    ok = F.count_if(F.col("status") == "succeeded")
    return entries.agg(
        F.when(ok == 0, "failed").when(ok == F.count(F.lit(1)), "succeeded").otherwise("partial").alias("status"),
        ok.alias("succeeded_entries"),
        F.count(F.lit(1)).alias("entries"),
    )


CONTRACT = ("task", "dataset_sha256", "target", "validation_fraction", "random_seed", "stratified",
            "partition_sha256")


def fair_contract(runs: DataFrame) -> DataFrame:
    """One row: run count, distinct contracts, non-successful runs."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.countDistinct("run_id").alias("distinct_runs"),
        F.count(F.lit(1)).alias("_n"),
        F.size(F.collect_set(F.struct(*CONTRACT))).alias("contracts"),
        F.count_if(F.col("status") != "succeeded").alias("unsuccessful"),
    ).drop("_n")


def compare_runs(runs: DataFrame, metrics: DataFrame, metric: str, *, check: bool = True) -> DataFrame:
    """Rank runs by one metric in its recorded direction, ties by run_id.

    ``runs``: registry rows (run_id, estimator, status, contract columns);
    ``metrics``: (run_id, metric, value, higher_is_better).
    """
    if check:
        c = fair_contract(runs).first()
        if c["runs"] < 2:
            raise ComparisonError("Comparing needs two or more runs.")
        if c["distinct_runs"] != c["runs"]:
            raise ComparisonError("A run appears twice in the comparison.")
        if c["unsuccessful"]:
            raise ComparisonError("Only successful runs take part in a comparison.")
        if c["contracts"] != 1:
            raise ComparisonError(
                "Runs are not comparable: they need the same task, data fingerprint, target, "
                "validation fraction, seed, stratification and row partition.")
    chosen = metrics.filter(F.col("metric") == metric).join(runs.select("run_id", "estimator"), "run_id")
    if check:
        d = chosen.agg(F.countDistinct("higher_is_better").alias("d"), F.count(F.lit(1)).alias("n")).first()
        if d["n"] != runs.count():
            raise ComparisonError(f"Metric {metric!r} is not present in every run.")
        if d["d"] != 1:
            raise ComparisonError("The metric direction differs between runs.")
    order = Window.orderBy(_directed(), F.col("run_id").asc())
    return chosen.withColumn("rank", F.row_number().over(order)).select(
        "rank", "run_id", "estimator", "value", "higher_is_better")


def list_runs(runs: DataFrame) -> DataFrame:
    """Chronological listing."""
    return runs.orderBy("started_at", "run_id")


def leaderboard_audit(stored: DataFrame) -> DataFrame:
    """Entries whose stored rank differs from a recomputation (empty = ok)."""
    recomputed = leaderboard_rank(stored.drop("rank")).select("run_id", F.col("rank").alias("_rank"))
    return stored.join(recomputed, "run_id").filter(~F.col("rank").eqNullSafe(F.col("_rank")))


def fold_plan_audit(snapshots: DataFrame, rows: int, fold_count: int) -> DataFrame:
    """One row of booleans about the fold plan."""
    return snapshots.agg(
        (F.count(F.lit(1)) == fold_count).alias("fold_count_ok"),
        (F.min("fold_number") == 1).alias("starts_at_one"),
        (F.max("fold_number") == fold_count).alias("ends_at_k"),
        (F.countDistinct("partition_sha256") == F.count(F.lit(1))).alias("unique_digests"),
        (F.sum("validation_rows") == rows).alias("validation_covers_rows"),
        (F.count_if(F.col("train_rows") + F.col("validation_rows") != rows) == 0).alias("every_fold_covers_rows"),
    )


def evidence_audit(per_fold: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries that disagree with their fold values (empty = ok)."""
    recomputed = fold_summaries(per_fold).select(
        "estimator", "metric", F.col("mean").alias("_m"), F.col("standard_deviation").alias("_s"))
    return summaries.join(recomputed, ["estimator", "metric"], "full_outer").filter(
        ~F.col("mean").eqNullSafe(F.col("_m")) | ~F.col("standard_deviation").eqNullSafe(F.col("_s")))
