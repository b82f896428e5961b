"""Small DataFrame-shaping helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row of ``df``.

    Each column is a scalar subquery: evaluated once, its value inlined
    into the projection -- no join and no shuffle of ``df``.
    """
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def unpivot_struct(df: DataFrame, rows: list) -> DataFrame:
    """``inline(array(struct...))``: one output row per struct per input row."""
    return df.select(F.inline(F.array(*rows)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], *, broadcast_right: bool = False,
                   how: str = "inner") -> DataFrame:
    """Equi-join, inner by default, on ``keys`` where NULL matches NULL (no row is lost
    because a key is missing); the right-hand key columns are dropped."""
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`")
                             for c in right.columns])
    if broadcast_right:
        renamed = F.broadcast(renamed)
    cond = None
    for c in keys:
        term = left[f"`{c}`"].eqNullSafe(renamed[f"_r_{c}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in keys])


ROW_KEY = "__row_key"


def with_row_key(df: DataFrame, name: str = ROW_KEY) -> DataFrame:
    """Add a deterministic unique key to a table that has none.

    Key = SHA-256 of the row's engine-stable content + ":" + an ordinal among
    identical rows.  Identical rows are interchangeable, so only the
    ordinal's uniqueness matters: it is rows of the same content in earlier
    input partitions (a prefix sum over a ``(content, partition)`` count
    table) plus the position inside the partition.  A row repeated across a
    third of the table is therefore numbered by many tasks, not one.

    The ordinal reads input partition ids, so ``df`` should have a
    deterministic partitioning (a file scan, or a persisted/checkpointed
    frame); the content part of the key never depends on it.
    """
    from pyspark.sql import Window

    from .digest import value_token

    tagged = df.select(
        "*",
        F.sha2(value_token(df), 256).alias("_rk_h"),
        F.spark_partition_id().alias("_rk_pid"),
        F.monotonically_increasing_id().alias("_rk_mid"),
    )
    counts = tagged.groupBy("_rk_h", "_rk_pid").agg(
        F.count(F.lit(1)).alias("_rk_n"), F.min("_rk_mid").alias("_rk_first"))
    earlier = Window.partitionBy("_rk_h").orderBy("_rk_pid")
    offsets = counts.withColumn("_rk_off", F.sum("_rk_n").over(earlier) - F.col("_rk_n"))
    within = Window.partitionBy("_rk_h", "_rk_pid").orderBy("_rk_mid")
    numbered = tagged.withColumn("_rk_pos", F.row_number().over(within) - 1)
    return (
        numbered.join(offsets.drop("_rk_n", "_rk_first"), ["_rk_h", "_rk_pid"])
        .withColumn(name, F.concat_ws(":", F.col("_rk_h"), (F.col("_rk_off") + F.col("_rk_pos")).cast("string")))
        .drop("_rk_h", "_rk_pid", "_rk_mid", "_rk_pos", "_rk_off")
    )
