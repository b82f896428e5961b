"""Deterministic holdout splits and stratified k-fold plans.

Row order is ``md5(seed:key)`` then the key itself, so assignments depend
only on the data and the seed: not on partitioning, file layout or engine.

A global ``row_number`` would put every row (or every row of a class, which
may be a third of the table) into one task.  ``ordered_rank`` avoids that:
the leading hex digits of the hash form buckets that are consistent with
the hash order, so a row's rank = rows in earlier buckets (prefix sum over
a small count table) + its rank inside its bucket (a window partitioned by
bucket).  The result is identical for any bucket width.  A holdout needs no
ranks: ``quota_part`` finds the last validation row and compares with it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FoldConfig, SplitConfig, SplitError, Task
from ..functions.columns import cleaned, row_key, seeded_hash
from ..functions.digest import digest_aggs, digest_from_state, hashed_tokens
from ..functions.frames import ROW_KEY, attach_scalars, join_null_safe
from . import checks

HASH = "_h"
BROADCAST_ROW_LIMIT = 2_000_000


def hex_digits_for(rows: int, per_bucket: int = 50_000) -> int:
    """Bucket width (hex digits) so a bucket holds ~``per_bucket`` rows."""
    if rows <= per_bucket:
        return 1
    return max(1, min(5, math.ceil(math.log(rows / per_bucket, 16))))


def ordered_rank(
    df: DataFrame,
    key: list[str],
    *,
    partition: list[str] | None = None,
    prefix: list[str] | None = None,
    digits: int = 3,
    groups_bound: int = 1,
    out: str = "_rank",
) -> DataFrame:
    """0-based rank of each row within ``partition`` ordered by
    ``(prefix..., _h, key...)``; ``df`` must carry the hash column ``_h``.

    ``groups_bound`` is a proven upper bound on distinct
    ``(partition, prefix)`` values; it sizes the offset table for the
    broadcast decision.
    """
    partition, prefix = list(partition or []), list(prefix or [])
    bucket = F.conv(F.substring(F.col(HASH), 1, digits), 16, 10).cast("long")
    tagged = df.withColumn("_bkt", bucket)
    counts = tagged.groupBy(*partition, *prefix, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    # Level 1: bucket offsets inside each (partition, prefix) group, one
    # window task per group.
    running = Window.partitionBy(*partition, *prefix).orderBy("_bkt")
    offsets = counts.withColumn("_off", F.sum("_cnt").over(running) - F.col("_cnt"))
    if prefix:
        # Level 2: offsets of the prefix groups themselves (groups_bound rows).
        totals = counts.groupBy(*partition, *prefix).agg(F.sum("_cnt").alias("_tot"))
        before = Window.partitionBy(*partition).orderBy(*prefix)
        group_off = totals.withColumn("_goff", F.sum("_tot").over(before) - F.col("_tot")).drop("_tot")
        offsets = join_null_safe(offsets, group_off, partition + prefix,
                                 broadcast_right=groups_bound <= BROADCAST_ROW_LIMIT)
        offsets = offsets.withColumn("_off", F.col("_off") + F.col("_goff")).drop("_goff")
    offsets = offsets.drop("_cnt")
    within = Window.partitionBy(*partition, *prefix, "_bkt").orderBy(HASH, *key)
    joined = join_null_safe(tagged, offsets, partition + prefix + ["_bkt"],
                            broadcast_right=groups_bound * 16**digits <= BROADCAST_ROW_LIMIT)
    return (
        joined
        .withColumn(out, F.col("_off") + F.row_number().over(within) - 1)
        .drop("_bkt", "_off")
    )


def quota_part(hashed: DataFrame, key: list[str], quotas: DataFrame | int, *, partition: list[str] | None = None,
               digits: int = 3, broadcast: bool = True) -> DataFrame:
    """``hashed`` with ``part``: 'validation' for the first rows of each
    partition in the order ``(_h, key...)``, as many as its ``_quota``.

    Keys must be unique.  The bucket counts name the bucket in which a quota
    ends; only its rows are sorted, for the last one that belongs to it, and
    every row is compared with that one: rows are not moved.
    """
    partition = list(partition or [])
    tagged = hashed.withColumn("_bkt", F.substring(F.col(HASH), 1, digits))
    counts = tagged.groupBy(*partition, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    if partition:
        counts = join_null_safe(counts, quotas, partition, broadcast_right=broadcast)
    else:
        counts = counts.withColumn("_quota", F.lit(quotas).cast("long"))
    before = F.sum("_cnt").over(Window.partitionBy(*partition).orderBy("_bkt")) - F.col("_cnt")
    need = F.col("_quota") - F.col("_before")
    ends = counts.withColumn("_before", before).filter((need > 0) & (need <= F.col("_cnt"))).select(
        *partition, "_bkt", need.alias("_need"))
    row = F.struct(HASH, *key)
    order = Window.partitionBy(*partition, "_bkt").orderBy(HASH, *key)
    last = (join_null_safe(tagged, ends, [*partition, "_bkt"], broadcast_right=broadcast)
            .withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == F.col("_need"))
            .select(*partition, row.alias("_last")))
    if partition:  # a class without validation rows has no last one
        sides = join_null_safe(quotas.select(*partition), last.groupBy(*partition).agg(F.first("_last").alias("_last")),
                               partition, broadcast_right=broadcast, how="left")
        held = join_null_safe(hashed, sides, partition, broadcast_right=broadcast)
    else:
        held = hashed.crossJoin(F.broadcast(last))
    return held.withColumn("part", F.when(row <= F.col("_last"), "validation").otherwise("train")).drop("_last")


@dataclass
class Split:
    """A split as one DataFrame with a ``part`` column ('train'/'validation')."""

    frame: DataFrame
    target: str
    key: tuple[str, ...]
    task: Task
    stratified: bool
    rows: int
    validation_rows: int
    feature_count: int
    config: SplitConfig
    _digest: str | None = None

    @property
    def train_rows(self) -> int:
        return self.rows - self.validation_rows

    def train(self) -> DataFrame:
        return self.frame.filter(F.col("part") == "train")

    def validation(self) -> DataFrame:
        return self.frame.filter(F.col("part") == "validation")

    def partition_sha256(self) -> str:
        """T4, computed once per split (one aggregation)."""
        if self._digest is None:
            self._digest = partition_digest(self.frame, list(self.key)).first()["partition_sha256"]
        return self._digest


def validation_quotas(class_counts: DataFrame, rows: int, validation_rows: int, target: str) -> DataFrame:
    """Per-class validation quota by integer largest remainder.

    ``floor(n_k * v / n)`` for each class, then the remaining rows go to the
    classes with the largest remainders, ties by class value.  Works on the
    small class table only.
    """
    wide = "decimal(38,0)"
    prod = F.col("_n").cast(wide) * F.lit(validation_rows).cast(wide)
    q = class_counts.select(
        F.col(target), F.col("_n"),
        F.floor(prod / F.lit(rows)).cast("long").alias("_base"),
        (prod % F.lit(rows)).alias("_rem"),
    )
    # Global order over the class table: one row per class (checked count).
    order = Window.orderBy(F.col("_rem").desc(), F.col(target).asc())
    leftover = q.agg((F.lit(validation_rows) - F.sum("_base")).alias("_left"))
    q = attach_scalars(q.withColumn("_pos", F.row_number().over(order)), leftover)
    return q.select(
        F.col(target),
        (F.col("_base") + F.when(F.col("_pos") <= F.col("_left"), 1).otherwise(0)).alias("_quota"),
    )


def split_dataset(
    df: DataFrame,
    *,
    target: str,
    key: list[str] | tuple[str, ...],
    task: Task,
    config: SplitConfig | None = None,
    check: bool = True,
) -> Split:
    """Exact-size holdout, stratified by default for classification."""
    cfg = config or SplitConfig()
    key = list(key)
    if not isinstance(task, Task):
        raise SplitError("task must be Task.CLASSIFICATION or Task.REGRESSION.")
    if target not in df.columns:
        raise SplitError(f"Target column {target!r} is not present.")
    features = [c for c in df.columns if c not in (target, ROW_KEY)]
    if not features:
        raise SplitError("Nothing to learn from: the table has no column besides the target.")
    if task is Task.REGRESSION and cfg.stratify is True:
        raise SplitError("Stratifying on the target needs a classification task.")
    stratified = task is Task.CLASSIFICATION if cfg.stratify is None else cfg.stratify
    report = checks.target_report(df, target, classes=stratified or task is Task.CLASSIFICATION).first()
    rows = int(report["rows"])
    if rows < 2:
        raise SplitError("A holdout needs two or more rows.")
    if check:
        checks.raise_for_target(report, task, df.schema[target].dataType, target)
        checks.raise_for_duplicate_keys(df, key)
    validation_rows = math.ceil(rows * float(cfg.validation_fraction))
    if validation_rows < 1 or rows - validation_rows < 1:
        raise SplitError("With this validation fraction one of the two parts would be empty.")
    if stratified:
        classes = int(report["classes"])
        if int(report["min_class_count"]) < 2:
            raise SplitError(
                "A stratified holdout needs every class to have two or more rows; "
                "pass stratify=False to split without classes."
            )
        if validation_rows < classes or rows - validation_rows < classes:
            raise SplitError(
                f"{classes} classes cannot all appear in both parts of a {rows}-row holdout "
                f"with {validation_rows} validation rows."
            )
    hashed = df.withColumn(HASH, seeded_hash(cfg.random_seed, key))
    digits = hex_digits_for(rows)
    if stratified:
        classes = int(report["classes"])
        counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
        quotas = validation_quotas(counts, rows, validation_rows, target)
        # One row per class, bounded by the checked class count.
        small = classes <= BROADCAST_ROW_LIMIT
    if check and stratified:
        frame = quota_part(hashed, key, quotas, partition=[target], digits=digits, broadcast=small).drop(HASH)
    elif check:
        frame = quota_part(hashed, key, validation_rows, digits=digits).drop(HASH)
    elif stratified:  # keys may repeat: every row needs its rank
        ranked = ordered_rank(hashed, key, partition=[target], digits=digits, groups_bound=classes)
        ranked = join_null_safe(ranked, quotas, [target], broadcast_right=small)
        part = F.when(F.col("_rank") < F.col("_quota"), "validation").otherwise("train")
        frame = ranked.withColumn("part", part).drop("_rank", "_quota", HASH)
    else:
        ranked = ordered_rank(hashed, key, digits=digits)
        part = F.when(F.col("_rank") < validation_rows, "validation").otherwise("train")
        frame = ranked.withColumn("part", part).drop("_rank", HASH)
    result = Split(frame, target, tuple(key), task, stratified, rows, validation_rows, len(features), cfg)
    if task is Task.CLASSIFICATION and check and not stratified:
        # Stratified quotas leave >= 1 train row per class (checked above).
        train_classes = result.train().select(target).distinct().limit(2).count()
        if train_classes < 2:
            raise SplitError("Only one class landed in the training part; stratify or use another seed.")
    return result


def assign_folds(
    df: DataFrame,
    *,
    target: str,
    key: list[str] | tuple[str, ...],
    config: FoldConfig | None = None,
    check: bool = True,
    rows: int | None = None,
    classes: int | None = None,
) -> DataFrame:
    """``fold`` in 1..k by round-robin over rows ordered (class, hash, key).

    Every class is spread over folds with sizes differing by at most one.
    """
    cfg = config or FoldConfig()
    key = list(key)
    if check or rows is None or classes is None:
        report = checks.target_report(df, target).first()
        rows, classes = int(report["rows"]), int(report["classes"])
        if check:
            if len([c for c in df.columns if c not in (target, ROW_KEY)]) == 0:
                raise SplitError("Nothing to learn from: the table has no column besides the target.")
            if rows < cfg.fold_count:
                raise SplitError(f"{rows} rows cannot fill {cfg.fold_count} folds.")
            checks.raise_for_target(report, Task.CLASSIFICATION, df.schema[target].dataType, target)
            checks.raise_for_duplicate_keys(df, key)
            smallest = int(report["min_class_count"])
            if smallest < cfg.fold_count:
                raise SplitError(
                    f"Every class must reach every fold: the rarest class has {smallest} rows, "
                    f"fewer than the {cfg.fold_count} folds requested."
                )
    hashed = df.withColumn(HASH, seeded_hash(cfg.random_seed, key))
    ranked = ordered_rank(
        hashed, key, prefix=[target], digits=hex_digits_for(rows), groups_bound=max(classes, 1)
    )
    return ranked.withColumn("fold", (F.col("_rank") % cfg.fold_count + 1).cast("int")).drop(
        "_rank", HASH
    )


def _part_token(key: list[str], part: Column) -> Column:
    return F.concat_ws(":", part, row_key(key))


def partition_digest(frame: DataFrame, key: list[str]) -> DataFrame:
    """T4: one-row digest of the exact (part, row) membership of a split."""
    spelled = frame.select("part", *[F.col(k).cast("string").alias(k) for k in key])  # once, not for each use
    hashed = hashed_tokens(spelled, {"_tk": _part_token(key, F.col("part"))})
    return hashed.agg(*digest_aggs("_tk")).select(
        F.col("_dg_n").alias("rows"), digest_from_state().alias("partition_sha256")
    )


def fold_snapshots(folded: DataFrame, key: list[str], fold_count: int) -> DataFrame:
    """T5/T8 per fold: train/validation rows and the fold's partition digest.

    A digest is a sum over rows, so each row is hashed twice, once as a
    validation and once as a training row, and summed in its own fold; fold
    k is then all training sums less its own plus its own validation sums.
    No row is copied; the table has one row a fold.
    """
    own = hashed_tokens(folded, {part: F.concat_ws(":", F.lit(part), row_key(key)) for part in ("train", "validation")},
                        ["fold"])
    held = own.groupBy("fold").agg(
        F.count(F.lit(1)).alias("_n"),
        *[total.alias(f"_{part[0]}{i}") for part in ("train", "validation")
          for i, total in enumerate(digest_aggs(part)[1:])])
    # A fold without rows still has its training side.
    every = folded.sparkSession.range(1, fold_count + 1).select(F.col("id").cast("int").alias("fold"))
    held = every.join(held, "fold", "left").fillna(0)
    zero = F.lit(0).cast("decimal(38,0)")
    sums = [c for c in held.columns if c not in ("fold", "_n")]
    held = held.select("fold", "_n", *[F.coalesce(F.col(c), zero).alias(c) for c in sums])
    total = held.agg(F.sum("_n").alias("_all"), *[F.sum(f"_t{i}").alias(f"_a{i}") for i in range(2)])
    state = attach_scalars(held, total)
    return state.select(
        F.col("fold").alias("fold_number"),
        (F.col("_all") - F.col("_n")).alias("train_rows"), F.col("_n").alias("validation_rows"),
        F.col("_all").alias("_dg_n"),
        *[(F.col(f"_a{i}") - F.col(f"_t{i}") + F.col(f"_v{i}")).cast("decimal(38,0)").alias(f"_dg_s{i + 1}")
          for i in range(2)],
    ).select("fold_number", "train_rows", "validation_rows", digest_from_state().alias("partition_sha256"))


def fold_plan_digest(snapshots: DataFrame) -> DataFrame:
    """T5: digest of the ordered fold snapshots (k <= 10 rows)."""
    line = F.concat_ws(
        ":",
        F.lpad(F.col("fold_number").cast("string"), 2, "0"),
        F.col("train_rows").cast("string"),
        F.col("validation_rows").cast("string"),
        F.col("partition_sha256"),
    )
    return snapshots.agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ","), 256).alias("fold_plan_sha256"),
    )


def target_class_column(df: DataFrame, target: str) -> Column:
    return cleaned(target, df.schema[target].dataType)
