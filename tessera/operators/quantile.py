"""Exact medians that stay distributed.

Spark's exact ``median``/``percentile`` keeps every distinct value of a
group in one aggregation buffer, and the final merge of a group runs in a
single task.  That is fine when the distinct count is known to be small
and fatal for a high-cardinality double column at scale.  So:

1. Rows are first reduced to ``(group, value, weight)`` with a hash
   aggregation (map-side combine; a hot value collapses before the shuffle).
2. If the largest distinct count per group is within ``in_memory_limit``
   (checked, or given by the caller), ``percentile(value, 0.5, weight)``
   runs on that table: each buffer is bounded by the checked count.
3. Otherwise an exact bucketed selection runs: approximate quantile
   boundaries (bounded sketch) cut each group into ``buckets`` ranges, the
   per-bucket weights (small table) give each bucket's starting rank, and
   only the one or two buckets that hold the middle ranks are sorted.

``fold_medians`` selects the medians of all folds' training sides at once.

``column_medians`` selects the medians of several columns of a table without
grouping their values: a sketch of each column brackets its middle ranks, one
pass over all rows counts the values below and inside the brackets, and only
values inside are grouped and sorted.  Counts are exact, so a bracket that misses a middle
rank is seen, and its column goes the way above.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IN_MEMORY_LIMIT = 2_000_000


def exact_medians(
    long_df: DataFrame,
    group_cols: list[str],
    value: str = "v",
    *,
    distinct_hint: int | None = None,
    in_memory_limit: int = IN_MEMORY_LIMIT,
    buckets: int = 128,
) -> DataFrame:
    """Median of ``value`` per group; ``long_df`` holds finite non-NULL values.

    Returns ``(group_cols..., median)``; even counts average the two middle
    values.  Groups without values are absent.
    """
    groups = list(group_cols)
    if not groups:
        long_df = long_df.withColumn("_g", F.lit(0))
        groups = ["_g"]
    weighted = long_df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_w"))
    if distinct_hint is None:
        row = (
            long_df.groupBy(*groups)
            .agg(F.approx_count_distinct(value, 0.05).alias("_d"))
            .agg(F.max("_d").alias("_m"))
            .first()
        )
        distinct_hint = int(row["_m"] or 0)
    if distinct_hint * 1.2 <= in_memory_limit:
        result = weighted.groupBy(*groups).agg(
            F.percentile(F.col(value), F.lit(0.5), F.col("_w")).alias("median")
        )
    else:
        result = _bucketed_median(long_df, weighted, groups, value, buckets)
    if not group_cols:
        result = result.drop("_g")
    return result


#: Rows whose values place the brackets, and half a bracket's width in ranks.
BRACKET_ROWS = 1_000_000
BRACKET_HALF = 0.005


def column_medians(df: DataFrame, values: dict[str, Column], rows: int, *, bracket_rows: int = BRACKET_ROWS
                   ) -> dict[str, float]:
    """Exact median of every column of finite or NULL doubles over all
    ``rows``; columns without values are absent.

    Where a bracket lies is a guess from some rows; below and inside it every
    row is counted, which shows whether it holds the middle ranks.
    """
    names = list(values)
    if not names or not rows:
        return {}
    held = df.select(*[v.alias(f"_v{i}") for i, v in enumerate(values.values())])
    at = [F.col(f"_v{i}") for i in range(len(names))]
    guess = held if rows <= bracket_rows else held.filter(F.rand(0) < bracket_rows / rows)
    fractions = [0.5 - BRACKET_HALF, 0.5 + BRACKET_HALF]
    found = guess.agg(*[F.percentile_approx(v, fractions, 1_000) for v in at]).first()
    seen = [i for i in range(len(names)) if found[i] is not None]
    inside = [at[i].between(F.lit(found[i][0]), F.lit(found[i][1])) for i in seen]
    counts = held.agg(*[c for i, within in zip(seen, inside) for c in (
        F.count(at[i]), F.count_if(at[i] < F.lit(found[i][0])), F.count_if(within))]).first() if seen else []
    medians, open_, missed = {}, {}, [i for i in range(len(names)) if found[i] is None and rows > bracket_rows]
    for k, i in enumerate(seen):
        n, below, kept = counts[3 * k:3 * k + 3]
        low, high = (n - 1) // 2 - below, n // 2 - below
        if low < 0 or high >= kept:
            missed.append(i)
        elif found[i][0] == found[i][1]:
            medians[names[i]] = found[i][0] + 0.0
        else:
            open_[i] = (inside[k], low, high)
    if open_:
        long = held.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), F.when(within, at[i]).alias("v"), F.lit(low).cast("long").alias("lo"),
                     F.lit(high).cast("long").alias("hi")) for i, (within, low, high) in open_.items()
        ]))).filter(F.col("v").isNotNull())
        ranked = long.groupBy("i", "lo", "hi", "v").agg(F.count(F.lit(1)).alias("w")).withColumn(
            "end", F.sum("w").over(Window.partitionBy("i").orderBy("v")))

        def picked(rank: str) -> Column:
            return F.max(F.when((F.col(rank) < F.col("end")) & (F.col(rank) >= F.col("end") - F.col("w")), F.col("v")))

        for r in ranked.groupBy("i").agg((picked("lo") / 2 + picked("hi") / 2).alias("median")).collect():
            medians[names[r["i"]]] = r["median"]
    if missed:
        long = held.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), at[i].alias("v")) for i in missed]))).filter(F.col("v").isNotNull())
        medians |= {names[r["i"]]: r["median"] for r in exact_medians(long, ["i"]).collect()}
    return medians


def count_below(bounds, v, lo: int, hi: int):
    """Number of sorted ``bounds[lo:hi]`` below ``v`` as a binary-search CASE
    tree: log2(buckets) comparisons per row, compiled by whole-stage codegen
    (a ``filter`` lambda would scan every bound, interpreted)."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.element_at(bounds, mid + 1) < v, count_below(bounds, v, mid + 1, hi)).otherwise(
        count_below(bounds, v, lo, mid))


def _bucketed_median(
    long_df: DataFrame, weighted: DataFrame, groups: list[str], value: str, buckets: int
) -> DataFrame:
    fractions = [i / buckets for i in range(1, buckets)]
    # One bounded sketch per group: groups x (buckets - 1) doubles.
    bounds = long_df.groupBy(*groups).agg(
        F.percentile_approx(F.col(value), fractions, 10_000).alias("_bounds")
    )
    if groups == ["_g"]:  # one global group: the bounds are a scalar subquery
        with_bounds = weighted.withColumn("_bounds", bounds.select("_bounds").scalar())
    else:  # one row per group: a bounded broadcast
        with_bounds = weighted.join(F.broadcast(bounds), groups)
    tagged = (
        with_bounds
        .withColumn("_b", count_below(F.col("_bounds"), F.col(value), 0, buckets - 1))
        .drop("_bounds")
    )
    per_bucket = tagged.groupBy(*groups, "_b").agg(F.sum("_w").alias("_bw"))
    ordered = Window.partitionBy(*groups).orderBy("_b")
    per_bucket = (
        per_bucket.withColumn("_start", F.sum("_bw").over(ordered) - F.col("_bw"))
        .withColumn("_n", F.sum("_bw").over(Window.partitionBy(*groups)))
        .withColumn("_klo", F.floor((F.col("_n") - 1) / 2))
        .withColumn("_khi", F.floor(F.col("_n") / 2))
    )

    def holds(k: str):
        return (F.col(k) >= F.col("_start")) & (F.col(k) < F.col("_start") + F.col("_bw"))

    targets = per_bucket.filter(holds("_klo") | holds("_khi")).select(
        *groups, "_b", "_start", "_klo", "_khi"
    )
    # At most two buckets per group reach the window below.
    within = Window.partitionBy(*groups, "_b").orderBy(value)
    candidates = (
        tagged.join(F.broadcast(targets), groups + ["_b"])
        .withColumn("_end", F.col("_start") + F.sum("_w").over(within))
        .withColumn("_first", F.col("_end") - F.col("_w"))
    )

    def pick(k: str, alias: str) -> DataFrame:
        return candidates.filter((F.col(k) >= F.col("_first")) & (F.col(k) < F.col("_end"))).select(
            *groups, F.col(value).alias(alias)
        )

    return (
        pick("_klo", "_lo")
        .join(pick("_khi", "_hi"), groups)
        .select(*groups, ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))
    )


def fold_medians(
    long_df: DataFrame, group_cols: list[str], fold: str, fold_count: int, value: str = "v"
) -> dict[tuple, list[float | None]]:
    """Medians of ``value`` per group over the rows outside each fold.

    Returns ``{group: medians}``; entry k - 1 is the median without fold k,
    None where no row is left.  Rows are not copied for the folds: each
    distinct value carries its count outside every fold, one range partitioning
    serves all folds, prefix sums per fold over the ranges' counts name the
    ranges that hold a wanted rank, and only these are sorted.
    """
    groups = list(group_cols)
    folds = range(1, fold_count + 1)
    outside = [F.count_if(F.col(fold) != k).alias(f"_n{k}") for k in folds]
    tagged = (long_df.groupBy(*groups, value).agg(*outside).repartitionByRange(*groups, value)
              .withColumn("_b", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK))
    ranges = tagged.groupBy(*groups, "_b").agg(*[F.sum(f"_n{k}").alias(f"_w{k}") for k in folds])
    upto, every = Window.partitionBy(*groups).orderBy("_b"), Window.partitionBy(*groups)
    ranges = ranges.select(
        *groups, "_b", *[f"_w{k}" for k in folds],
        *[(F.sum(f"_w{k}").over(upto) - F.col(f"_w{k}")).alias(f"_s{k}") for k in folds],
        *[F.floor((F.sum(f"_w{k}").over(every) - 1) / 2).alias(f"_lo{k}") for k in folds],
        *[F.floor(F.sum(f"_w{k}").over(every) / 2).alias(f"_hi{k}") for k in folds])
    needed = F.lit(False)
    for k in folds:
        for rank in (f"_lo{k}", f"_hi{k}"):
            needed = needed | ((F.col(rank) >= F.col(f"_s{k}")) & (F.col(rank) < F.col(f"_s{k}") + F.col(f"_w{k}")))
    targets = ranges.filter(needed).drop(*[f"_w{k}" for k in folds])
    within = Window.partitionBy(*groups, "_b").orderBy(value)
    found = tagged.join(F.broadcast(targets), [*groups, "_b"]).select(
        *groups, value, *[c for k in folds for c in (f"_n{k}", f"_lo{k}", f"_hi{k}")],
        *[(F.col(f"_s{k}") + F.sum(f"_n{k}").over(within)).alias(f"_e{k}") for k in folds])

    def at(rank: str, k: int):
        holds = (F.col(rank) >= F.col(f"_e{k}") - F.col(f"_n{k}")) & (F.col(rank) < F.col(f"_e{k}"))
        return F.max(F.when(holds, F.col(value)))

    medians = found.groupBy(*groups).agg(F.array(*[
        (at(f"_lo{k}", k) + at(f"_hi{k}", k)) / 2 for k in folds]).alias("_medians"))
    try:
        return {tuple(r[g] for g in groups): r["_medians"] for r in medians.collect()}
    finally:
        tagged.unpersist()
