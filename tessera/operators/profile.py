"""Data-quality profiling (advisory; never changes the input).

All per-column statistics come from one wide aggregation; duplicates,
class distribution and medians are one job each.  Results are small
DataFrames (one row per column / class) plus a driver-side summary object
assembled from those small results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    HIGH_CARDINALITY_MINIMUM,
    HIGH_CARDINALITY_RATIO,
    IMBALANCE_RATIO_THRESHOLD,
    MAX_CLASS_DISTRIBUTION_VALUES,
    as_double,
    cleaned,
    finite_or_null,
    identifier_name,
    is_infinite,
    kind_of,
)
from ..functions.digest import content_hash, shortest_text, value_token
from ..functions.frames import attach_scalars
from .quantile import column_medians

def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _value_text(name: str, dtype: T.DataType) -> Column | None:
    """Engine-stable text of a non-numeric value for distinct counting."""
    col = F.col(f"`{name}`")
    kind = kind_of(dtype)
    if kind == "string":
        return col
    if kind == "boolean":
        return col.cast("string")
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)").cast("string")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col).cast("string")
    if isinstance(dtype, T.DateType):
        return F.datediff(col, F.lit("1970-01-01").cast("date")).cast("string")
    return None


def _short(text: Column) -> Column:
    """A text as a grouping key of bounded size: long ones by their digest."""
    return F.when(F.octet_length(text) > 64, F.sha2(text, 256)).otherwise(text)


def column_profiles(
    df: DataFrame, columns: list[str] | None = None, *, exact_distinct: bool = True
) -> DataFrame:
    """One row per column.

    1. One wide aggregation: counts, infinite counts and finite
       min/max/mean/sd per column.
    2. The exact medians (``quantile.column_medians``).
    3. Tables ``(column, value)`` of the distinct values, one of numbers and
       one of texts (partial aggregation map-side): their per-column row
       counts are the exact distinct counts.

    ``exact_distinct=False`` reports the HLL estimates as distinct counts.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = columns or df.columns
    numeric = [n for n in names if kind_of(fields[n]) in ("integer", "float")]
    texts = {n: _value_text(n, fields[n]) for n in names if n not in numeric}
    opaque = [n for n in names if n not in numeric and texts[n] is None]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(names):
        c = cleaned(name, fields[name])
        aggs.append(F.count(c).alias(f"_nm{i}"))
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(c).alias(f"_ud{i}"))
        if name in opaque:  # arrays, maps, structs, binary: Spark's own distinct
            aggs.append(F.countDistinct(c).alias(f"_ux{i}"))
        if name in numeric:
            d = as_double(name, fields[name])
            fin = finite_or_null(d)
            aggs += [
                F.count_if(is_infinite(d)).alias(f"_inf{i}"),
                F.min(fin).alias(f"_min{i}"),
                F.max(fin).alias(f"_max{i}"),
                F.avg(fin).alias(f"_avg{i}"),
                F.stddev_samp(fin).alias(f"_sd{i}"),
            ]
    wide_df = df.agg(*aggs)
    wide_row = wide_df.first()
    wide = df.sparkSession.range(1).select(*[
        F.lit(wide_row[f.name]).cast(f.dataType).alias(f.name) for f in wide_df.schema.fields])
    none = F.lit(None).cast("double")
    structs = []
    for i, name in enumerate(names):
        is_num = name in numeric
        structs.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(name).alias("column_name"),
                F.lit(kind_of(fields[name])).alias("kind"),
                F.col("_rows").alias("rows"),
                F.col(f"_nm{i}").alias("non_missing_count"),
                (F.col(f"_ux{i}") if name in opaque else F.lit(0).cast("bigint") if exact_distinct
                 else F.col(f"_ud{i}")).alias("_approx_unique"),
                (F.col(f"_inf{i}") if is_num else F.lit(0).cast("bigint")).alias("infinite_count"),
                (F.col(f"_min{i}") if is_num else none).alias("minimum"),
                (F.col(f"_max{i}") if is_num else none).alias("maximum"),
                (F.col(f"_avg{i}") if is_num else none).alias("mean"),
                (F.col(f"_sd{i}") if is_num else none).alias("standard_deviation"),
                F.lit(identifier_name(name)).alias("_id_name"),
            )
        )
    long = wide.select(F.inline(F.array(*structs)))
    counted = [n for n in names if n not in opaque]
    if counted:
        # Values of one kind share a table of (column, value): numbers are
        # grouped by fixed-width keys.
        found = column_medians(df, {n: finite_or_null(as_double(n, fields[n])) for n in numeric}, wide_row["_rows"])
        kinds = [[(n, as_double(n, fields[n])) for n in numeric],
                 [(n, _short(texts[n])) for n in counted if n not in numeric]]
        uniques: dict[str, int] = {}
        for kind in kinds if exact_distinct else []:
            if kind:
                values = df.select(F.inline(F.array(*[
                    F.struct(F.lit(names.index(n)).alias("i"), v.alias("v")) for n, v in kind
                ]))).filter(F.col("v").isNotNull()).groupBy("i", "v").agg(F.lit(1))
                sizes = values.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()
                uniques |= {names[r["i"]]: r["n"] for r in sizes}
        unique = F.array(*[F.lit(uniques.get(n)).cast("bigint") for n in names])
        median = F.array(*[F.lit(found.get(n)).cast("double") for n in names])
        long = long.withColumn("_unique", F.element_at(unique, F.col("position"))).withColumn(
            "median", F.element_at(median, F.col("position")))
    else:
        long = long.withColumn("_unique", F.lit(None).cast("bigint")).withColumn("median", none)
    unique = F.col("_approx_unique") if not exact_distinct else F.coalesce(
        F.col("_unique"), F.when(F.col("non_missing_count") == 0, F.lit(0)), F.col("_approx_unique"))
    long = long.withColumn("unique_count", unique.cast("bigint"))
    rows, nm, ud = F.col("rows"), F.col("non_missing_count"), F.col("unique_count")
    return long.select(
        "position", "column_name", "kind", "non_missing_count",
        (rows - nm).alias("missing_count"),
        _ratio(rows - nm, rows).alias("missing_ratio"),
        "unique_count",
        _ratio(ud, nm).alias("unique_ratio"),
        "infinite_count",
        (ud <= 1).alias("is_constant"),
        (F.col("kind").isin("string") & (ud >= HIGH_CARDINALITY_MINIMUM)
         & (_ratio(ud, nm) >= HIGH_CARDINALITY_RATIO)).alias("is_high_cardinality"),
        ((rows > 0) & (nm == rows) & (ud == rows) & F.col("_id_name")).alias("is_likely_identifier"),
        "minimum",
        "maximum",
        "mean",
        "median",
        "standard_deviation",
    )


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """P10: rows beyond the first of each identical row (NULLs compare equal).

    Rows that share no 64-bit hash are different, so 8 bytes a row are
    shuffled first.  Only rows whose hash repeats are told apart by a 256-bit
    digest of their exact content; partial aggregation collapses a hot
    duplicated row map-side.
    """
    hashed = df.withColumn("_row_hash", content_hash(df, df.columns))
    counts = hashed.groupBy("_row_hash").agg(F.count(F.lit(1)).alias("_n"))
    repeated = counts.filter(F.col("_n") > 1).select("_row_hash")
    if not repeated.agg(F.count(F.lit(1))).first()[0]:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicate_rows"))
    return (
        hashed.join(repeated, "_row_hash", "left_semi")
        .groupBy(F.unhex(F.sha2(value_token(df, spell=shortest_text), 256)).alias("_row"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """Missing cells (NULL or NaN) over rows x columns."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    missing = sum(
        (F.count_if(cleaned(n, fields[n]).isNull()) for n in df.columns), F.lit(0).cast("bigint")
    )
    cells = F.count(F.lit(1)) * F.lit(len(df.columns))
    return df.agg(
        missing.cast("bigint").alias("missing_cells"),
        cells.cast("bigint").alias("cell_count"),
    ).select(
        "missing_cells", "cell_count",
        _ratio(F.col("missing_cells"), F.col("cell_count")).alias("missing_cell_ratio"),
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``(value, count)`` of the non-missing target values."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    t = cleaned(target, fields[target])
    return (
        df.select(t.alias("_t"))
        .filter(F.col("_t").isNotNull())
        .groupBy("_t")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("_t").cast("string").alias("value"), "count")
    )


def class_distribution(df: DataFrame, target: str, top: int = MAX_CLASS_DISTRIBUTION_VALUES) -> DataFrame:
    """Top classes by (count desc, value asc) with ratio over non-missing.

    Uses a take-ordered top-k (per-partition heaps), never a global window.
    """
    counts = class_counts(df, target)
    total = counts.agg(F.sum("count").alias("_total"))
    top_rows = counts.orderBy(F.col("count").desc(), F.col("value").asc()).limit(top)
    return attach_scalars(top_rows, total).select(
        "value", "count", (F.col("count") / F.col("_total")).alias("ratio")
    )


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """P12 + P13: one row with counts, task hint, imbalance and truncation."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    kind = kind_of(fields[target])
    counts = class_counts(df, target)
    s = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("non_missing_count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.min("count").alias("_min"),
        F.max("count").alias("_max"),
    )
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    s = attach_scalars(s, rows)
    nm, ud = F.col("non_missing_count"), F.col("unique_count")
    if kind in ("boolean", "string"):
        hint = F.when((ud < 2) | (nm == 0), "undetermined").otherwise("classification")
    elif kind in ("integer", "float"):
        limit = F.least(F.lit(20), F.greatest(F.lit(2), F.floor(F.sqrt(nm)).cast("bigint")))
        hint = (
            F.when((ud < 2) | (nm == 0), "undetermined")
            .when(ud <= limit, "classification")
            .otherwise("regression")
        )
    else:
        hint = F.lit("undetermined")
    s = s.withColumn("task_hint", hint)
    is_cls = F.col("task_hint") == "classification"
    return s.select(
        F.lit(target).alias("target"),
        "task_hint",
        "non_missing_count",
        (F.col("_rows") - nm).alias("missing_count"),
        "unique_count",
        (is_cls & (ud >= 2) & ((F.col("_min") / F.col("_max")) < IMBALANCE_RATIO_THRESHOLD)).alias(
            "imbalance_warning"
        ),
        (is_cls & (ud > MAX_CLASS_DISTRIBUTION_VALUES)).alias("distribution_truncated"),
    )


@dataclass
class DatasetProfile:
    """The assembled profile (small; built from the DataFrames above)."""

    rows: int
    columns: list[dict]
    missing_cell_count: int
    missing_cell_ratio: float
    duplicate_row_count: int
    target: dict
    class_distribution: list[dict]
    warnings: list[str] = field(default_factory=list)

    def column(self, name: str) -> dict:
        return next(c for c in self.columns if c["column_name"] == name)

    def to_json(self, indent: int | None = 2) -> str:
        """Deterministic JSON (sorted keys; non-finite values are already NULL)."""
        import json

        return json.dumps(
            {"rows": self.rows, "columns": self.columns, "missing_cell_count": self.missing_cell_count,
             "missing_cell_ratio": self.missing_cell_ratio, "duplicate_row_count": self.duplicate_row_count,
             "target": self.target, "class_distribution": self.class_distribution, "warnings": self.warnings},
            sort_keys=True, allow_nan=False, indent=indent)


# The advisory message formats, in the order they are emitted.
WARNING_FORMATS = (
    ("missing_cells", "Dataset contains {n} missing cells."),
    ("duplicate_rows", "Dataset contains {n} duplicate rows."),
    ("is_constant", "Constant columns: {names}."),
    ("is_high_cardinality", "High-cardinality columns: {names}."),
    ("is_likely_identifier", "Likely identifier columns: {names}."),
    ("infinite_count", "Columns containing infinite values: {names}."),
    ("target_missing", "Target column {target!r} contains missing values."),
    ("imbalance_warning", "Target column {target!r} appears imbalanced."),
    ("undetermined", "Task type could not be inferred from target column {target!r}."),
)


def profile_warnings(
    columns: list[dict], target: dict, missing_cell_count: int, duplicate_rows: int
) -> list[str]:
    """The nine advisory messages that apply, in their fixed order."""
    name = target["target"]
    counts = {"missing_cells": missing_cell_count, "duplicate_rows": duplicate_rows}
    flags = {
        "target_missing": bool(target["missing_count"]),
        "imbalance_warning": bool(target["imbalance_warning"]),
        "undetermined": target["task_hint"] == "undetermined",
    }
    out: list[str] = []
    for kind, template in WARNING_FORMATS:
        if kind in counts:
            if counts[kind]:
                out.append(template.format(n=counts[kind]))
        elif kind in flags:
            if flags[kind]:
                out.append(template.format(target=name))
        else:
            names = [c["column_name"] for c in columns if c[kind]]
            if names:
                out.append(template.format(names=", ".join(names)))
    return out


def profile_dataset(df: DataFrame, target: str) -> DatasetProfile:
    """Run P1-P14 and assemble the small result on the driver."""
    if target not in df.columns:
        from ..config import DatasetError

        raise DatasetError(f"Target column {target!r} is not present.")
    cols = [r.asDict() for r in column_profiles(df).orderBy("position").collect()]
    missing_total = sum(int(c["missing_count"]) for c in cols)
    cell_count = (cols[0]["non_missing_count"] + cols[0]["missing_count"]) * len(cols) if cols else 0
    cells = {"missing_cells": missing_total,
             "missing_cell_ratio": missing_total / cell_count if cell_count else 0.0}
    dups = duplicate_row_count(df).first()["duplicate_rows"]
    tgt = target_summary(df, target).first().asDict()
    dist = []
    if tgt["task_hint"] == "classification":
        dist = [r.asDict() for r in class_distribution(df, target).orderBy(
            F.col("count").desc(), F.col("value")).collect()]
    warnings = profile_warnings(cols, tgt, cells["missing_cells"], dups)
    rows = cols[0]["non_missing_count"] + cols[0]["missing_count"] if cols else 0
    ratio = cells["missing_cell_ratio"]
    return DatasetProfile(
        rows=rows,
        columns=cols,
        missing_cell_count=int(cells["missing_cells"]),
        missing_cell_ratio=float(ratio) if ratio is not None and math.isfinite(ratio) else 0.0,
        duplicate_row_count=int(dups),
        target=tgt,
        class_distribution=dist,
        warnings=warnings,
    )
