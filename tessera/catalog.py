"""Registered queries over the test tables and their SQL counterparts.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, sql | None)``.
The SQL runs in DuckDB over the same parquet tables; queries without SQL
(iterative model fitting) only get a row-count check.  Missing values are
injected in both engines by key modulus because the test tables have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import identifier_name
from .operators import profile as P

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def _six_decimals(df: DataFrame) -> DataFrame:
    """Doubles rounded for the comparison; the operators return full values."""
    def shown(name: str, kind: str) -> F.Column:
        if kind == "double":
            return F.round(name, 6).alias(name)
        if kind == "array<double>":
            return F.transform(name, lambda v: F.round(v, 6)).alias(name)
        return F.col(name)
    return df.select(*[shown(n, k) for n, k in df.dtypes])


def register(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        rounded = sql is None or "round(" in sql
        REGISTRY[name] = ((lambda spark, sf_dir: _six_decimals(fn(spark, sf_dir))) if rounded else fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- SQL helpers


def _clean(col: str, kind: str) -> str:
    return f"CASE WHEN isnan({col}) THEN NULL ELSE {col} END" if kind == "float" else col


def sql_column_profiles(source: str, columns: list[tuple[str, str]]) -> str:
    """SQL for ``column_profiles``: ``columns`` = (name, kind) in table order."""
    parts = []
    for i, (name, kind) in enumerate(columns, start=1):
        id_name = identifier_name(name)
        c = _clean(name, kind)
        d = f"CAST({c} AS DOUBLE)"
        fin = f"CASE WHEN isfinite({d}) THEN {d} END"
        nm, ud = f"count({c})", f"count(DISTINCT {c})"
        ud_ratio = f"(CASE WHEN {nm} > 0 THEN CAST({ud} AS DOUBLE) / {nm} ELSE 0.0 END)"
        high = f"({ud} >= 50 AND {ud_ratio} >= 0.5)" if kind == "string" else "false"
        if kind in ("integer", "float"):
            infinite = f"count(*) FILTER (WHERE isinf({d}))"
            stats = [f"round({fn}({fin}), 6)" for fn in ("min", "max", "avg", "median", "stddev_samp")]
        else:
            infinite = "CAST(0 AS BIGINT)"
            stats = ["CAST(NULL AS DOUBLE)"] * 5
        items = [
            f"{i} AS position",
            f"'{name}' AS column_name",
            f"'{kind}' AS kind",
            f"{nm} AS non_missing_count",
            f"count(*) - {nm} AS missing_count",
            f"round(CASE WHEN count(*) > 0 THEN CAST(count(*) - {nm} AS DOUBLE) / count(*) ELSE 0.0 END, 6) AS missing_ratio",
            f"{ud} AS unique_count",
            f"round({ud_ratio}, 6) AS unique_ratio",
            f"{infinite} AS infinite_count",
            f"{ud} <= 1 AS is_constant",
            f"{high} AS is_high_cardinality",
            f"(count(*) > 0 AND {nm} = count(*) AND {ud} = count(*) AND {str(id_name).lower()}) AS is_likely_identifier",
            f"{stats[0]} AS minimum",
            f"{stats[1]} AS maximum",
            f"{stats[2]} AS mean",
            f"{stats[3]} AS median",
            f"{stats[4]} AS standard_deviation",
        ]
        parts.append("SELECT " + ", ".join(items) + f" FROM {source}")
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ profiling


@register(
    "profile_columns_orders",
    sql_column_profiles(
        "orders",
        [
            ("o_orderkey", "integer"),
            ("o_custkey", "integer"),
            ("o_orderstatus", "string"),
            ("o_totalprice", "float"),
            ("o_orderdate", "datetime"),
            ("o_orderpriority", "string"),
        ],
    ),
)
def profile_columns_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P8 over every column of ``orders``."""
    return P.column_profiles(table(spark, sf_dir, "orders"))


# ------------------------------------------------------------ splits and folds

from .config import FoldConfig, SplitConfig, Task  # noqa: E402
from .functions.digest import sql_digest, sql_exact_text, sql_framed  # noqa: E402
from .operators import checks as V  # noqa: E402
from .operators import split as T  # noqa: E402


def sql_hash(seed: int, key: str) -> str:
    return f"md5('{seed}:' || " + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key.split(", ")) + ")"


def sql_holdout(source: str, key: str, fraction: float = 0.2, seed: int = 42) -> str:
    """Unstratified holdout: the first ceil(n*f) rows in hash order validate."""
    return (
        f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {sql_hash(seed, key)}, {key}) - 1 "
        f"< ceil(count(*) OVER () * CAST({fraction} AS DOUBLE)) THEN 'validation' ELSE 'train' END AS part "
        f"FROM {source}"
    )


def sql_stratified(source: str, key: str, target: str, fraction: float = 0.2, seed: int = 42) -> str:
    """Stratified holdout with largest-remainder class quotas."""
    return f"""
WITH base AS (SELECT *, {sql_hash(seed, key)} AS _h FROM {source}),
n AS (SELECT count(*) AS rows_, CAST(ceil(count(*) * CAST({fraction} AS DOUBLE)) AS BIGINT) AS v FROM base),
cc AS (SELECT {target} AS _t, count(*) AS nk FROM base GROUP BY {target}),
q0 AS (SELECT _t, CAST((CAST(nk AS HUGEINT) * v) // rows_ AS BIGINT) AS base_q,
              (CAST(nk AS HUGEINT) * v) % rows_ AS rem, v FROM cc, n),
q1 AS (SELECT _t, base_q, row_number() OVER (ORDER BY rem DESC, _t ASC) AS pos,
              v - sum(base_q) OVER () AS left_ FROM q0),
quota AS (SELECT _t, base_q + CASE WHEN pos <= left_ THEN 1 ELSE 0 END AS quota FROM q1),
r AS (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY _h, {key}) - 1 AS _rk FROM base)
SELECT r.* EXCLUDE (_h, _rk), CASE WHEN _rk < quota THEN 'validation' ELSE 'train' END AS part
FROM r JOIN quota ON r.{target} = quota._t"""


def sql_folds(source: str, key: str, target: str, k: int = 5, seed: int = 42) -> str:
    return (
        f"SELECT *, CAST((row_number() OVER (ORDER BY {target}, {sql_hash(seed, key)}, {key}) - 1) "
        f"% {k} + 1 AS INTEGER) AS fold FROM {source}"
    )


def sql_fold_snapshots(folded: str, key: str, k: int = 5) -> str:
    token = "part || ':' || " + sql_framed(f"CAST({key} AS VARCHAR)")
    return f"""
SELECT CAST(fold_number AS INTEGER) AS fold_number,
       count(*) FILTER (WHERE part = 'train') AS train_rows,
       count(*) FILTER (WHERE part = 'validation') AS validation_rows,
       {sql_digest(token)} AS partition_sha256
FROM (SELECT f.{key}, t.fold_number,
             CASE WHEN f.fold = t.fold_number THEN 'validation' ELSE 'train' END AS part
      FROM ({folded}) f, range(1, {k + 1}) t(fold_number))
GROUP BY fold_number"""


def orders_holdout(spark, sf_dir):
    return T.split_dataset(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
        target="o_totalprice", key=["o_orderkey"], task=Task.REGRESSION, config=SplitConfig(),
    )


def events_stratified(spark, sf_dir):
    return T.split_dataset(
        table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type"),
        target="event_type", key=["event_id"], task=Task.CLASSIFICATION, config=SplitConfig(),
    )


def orders_folds(spark, sf_dir, k: int = 5):
    return T.assign_folds(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"),
        target="o_orderstatus", key=["o_orderkey"], config=FoldConfig(fold_count=k),
    )


@register(
    "split_holdout",
    "SELECT o_orderkey, part FROM ("
    + sql_holdout("(SELECT o_orderkey FROM orders)", "o_orderkey") + ")",
)
def split_holdout(spark, sf_dir):
    """Unstratified 20% holdout of orders (regression target o_totalprice)."""
    return orders_holdout(spark, sf_dir).frame.select("o_orderkey", "part")


@register(
    "split_stratified",
    "SELECT event_id, event_type, part FROM ("
    + sql_stratified("(SELECT event_id, event_type FROM events)", "event_id", "event_type") + ")",
)
def split_stratified(spark, sf_dir):
    """Stratified 20% holdout of events by event_type."""
    return events_stratified(spark, sf_dir).frame.select("event_id", "event_type", "part")


@register(
    "split_disjoint",
    "SELECT count(*) AS rows, count(*) FILTER (WHERE part = 'train') AS train_rows, "
    "count(*) FILTER (WHERE part = 'validation') AS validation_rows, "
    "CAST(0 AS BIGINT) AS keys_in_both_parts, CAST(0 AS BIGINT) AS duplicate_keys FROM ("
    + sql_stratified("(SELECT event_id, event_type FROM events)", "event_id", "event_type") + ")",
)
def split_disjoint(spark, sf_dir):
    """Split integrity (coverage, disjointness, key uniqueness)."""
    return V.split_integrity(events_stratified(spark, sf_dir).frame, ["event_id"])


@register(
    "split_class_counts",
    "SELECT event_type, part, count(*) AS n FROM ("
    + sql_stratified("(SELECT event_id, event_type FROM events)", "event_id", "event_type")
    + ") GROUP BY event_type, part",
)
def split_class_counts(spark, sf_dir):
    """Per-class rows in each part of the stratified split."""
    return events_stratified(spark, sf_dir).frame.groupBy("event_type", "part").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "partition_digest",
    "SELECT count(*) AS rows, "
    + sql_digest("part || ':' || " + sql_framed("CAST(event_id AS VARCHAR)"))
    + " AS partition_sha256 FROM ("
    + sql_stratified("(SELECT event_id, event_type FROM events)", "event_id", "event_type") + ")",
)
def partition_digest(spark, sf_dir):
    """T4: membership digest of the stratified events split."""
    return T.partition_digest(events_stratified(spark, sf_dir).frame, ["event_id"])


@register(
    "kfold_assign",
    "SELECT o_orderkey, o_orderstatus, fold FROM ("
    + sql_folds("(SELECT o_orderkey, o_orderstatus FROM orders)", "o_orderkey", "o_orderstatus") + ")",
)
def kfold_assign(spark, sf_dir):
    """Stratified 5-fold assignment of orders by o_orderstatus."""
    return orders_folds(spark, sf_dir).select("o_orderkey", "o_orderstatus", "fold")


@register(
    "kfold_counts",
    "SELECT fold, o_orderstatus, count(*) AS n FROM ("
    + sql_folds("(SELECT o_orderkey, o_orderstatus FROM orders)", "o_orderkey", "o_orderstatus")
    + ") GROUP BY fold, o_orderstatus",
)
def kfold_counts(spark, sf_dir):
    """Rows per (fold, class): every class spread within one row."""
    return orders_folds(spark, sf_dir).groupBy("fold", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )


_ORDERS_FOLDS_SQL = sql_folds("(SELECT o_orderkey, o_orderstatus FROM orders)", "o_orderkey", "o_orderstatus")


@register("fold_snapshots", sql_fold_snapshots(_ORDERS_FOLDS_SQL, "o_orderkey"))
def fold_snapshots(spark, sf_dir):
    """Per-fold train/validation rows and membership digests."""
    return T.fold_snapshots(orders_folds(spark, sf_dir), ["o_orderkey"], 5)


@register(
    "fold_plan_digest",
    "SELECT count(*) AS fold_count, sha256(string_agg(lpad(CAST(fold_number AS VARCHAR), 2, '0') "
    "|| ':' || CAST(train_rows AS VARCHAR) || ':' || CAST(validation_rows AS VARCHAR) || ':' || "
    "partition_sha256, ',' ORDER BY lpad(CAST(fold_number AS VARCHAR), 2, '0') "
    "|| ':' || CAST(train_rows AS VARCHAR) || ':' || CAST(validation_rows AS VARCHAR) || ':' || "
    "partition_sha256)) AS fold_plan_sha256 FROM (" + sql_fold_snapshots(_ORDERS_FOLDS_SQL, "o_orderkey") + ")",
)
def fold_plan_digest(spark, sf_dir):
    """T5: digest of the ordered fold plan."""
    return T.fold_plan_digest(T.fold_snapshots(orders_folds(spark, sf_dir), ["o_orderkey"], 5))


# ------------------------------------------------- injected missing values

def events_dirty(spark, sf_dir) -> DataFrame:
    """events with NULL (id % 37), +inf (id % 101) and -inf (id % 103) in value."""
    e = table(spark, sf_dir, "events")
    value = (
        F.when(F.col("event_id") % 37 == 0, F.lit(None).cast("double"))
        .when(F.col("event_id") % 101 == 0, F.lit(float("inf")))
        .when(F.col("event_id") % 103 == 0, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return e.select("event_id", "user_id", "event_type", value.alias("value"))


EVENTS_DIRTY_SQL = (
    "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 37 = 0 THEN NULL "
    "WHEN event_id % 101 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 103 = 0 "
    "THEN CAST('-inf' AS DOUBLE) ELSE value END AS value FROM events)"
)


def events_missing(spark, sf_dir) -> DataFrame:
    """events with NULL value at id % 37 (no infinities: trainable)."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 37 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return e.select("event_id", "user_id", value.alias("value"), "event_type")


EVENTS_MISSING_SQL = (
    "(SELECT event_id, user_id, CASE WHEN event_id % 37 = 0 THEN NULL ELSE value END AS value, "
    "event_type FROM events)"
)


@register(
    "profile_numeric_events",
    sql_column_profiles(EVENTS_DIRTY_SQL, [("event_id", "integer"), ("user_id", "integer"),
                                           ("event_type", "string"), ("value", "float")]),
)
def profile_numeric_events(spark, sf_dir):
    """Missing, infinite, finite-only summaries on events with injected gaps."""
    return P.column_profiles(events_dirty(spark, sf_dir))


@register(
    "profile_columns_customer",
    sql_column_profiles("customer", [("c_custkey", "integer"), ("c_name", "string"),
                                     ("c_nationkey", "integer"), ("c_acctbal", "float"),
                                     ("c_mktsegment", "string")]),
)
def profile_columns_customer(spark, sf_dir):
    """High-cardinality c_name; c_custkey not an identifier by name."""
    return P.column_profiles(table(spark, sf_dir, "customer"))


@register(
    "profile_columns_documents",
    sql_column_profiles("documents", [("doc_id", "integer"), ("text", "string"), ("lang", "string"),
                                      ("source", "string"), ("n_chars", "integer")]),
)
def profile_columns_documents(spark, sf_dir):
    """doc_id is a likely identifier (complete, unique, ``*_id``)."""
    return P.column_profiles(table(spark, sf_dir, "documents"))


@register(
    "profile_missing_cells",
    "SELECT CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS missing_cells, "
    "CAST(count(*) * 4 AS BIGINT) AS cell_count, "
    "round(CAST(count(*) FILTER (WHERE value IS NULL) AS DOUBLE) / (count(*) * 4), 6) AS missing_cell_ratio "
    "FROM " + EVENTS_DIRTY_SQL,
)
def profile_missing_cells(spark, sf_dir):
    """Missing cells over rows x columns."""
    return P.missing_cells(events_dirty(spark, sf_dir))


@register(
    "duplicate_rows",
    "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM "
    "(SELECT count(*) AS c FROM events GROUP BY event_id, ts, user_id, event_type, value, props)",
)
def duplicate_rows(spark, sf_dir):
    """P10: duplicate rows of events, over all its columns."""
    return P.duplicate_row_count(table(spark, sf_dir, "events"))


def _sql_class_distribution(source: str, target: str) -> str:
    return (
        f"SELECT value, count, round(CAST(count AS DOUBLE) / total, 6) AS ratio FROM ("
        f"SELECT CAST({target} AS VARCHAR) AS value, count(*) AS count, sum(count(*)) OVER () AS total "
        f"FROM {source} WHERE {target} IS NOT NULL GROUP BY {target}) "
        f"ORDER BY count DESC, value ASC LIMIT 20"
    )


@register("class_distribution_quality", _sql_class_distribution("labels", "quality"))
def class_distribution_quality(spark, sf_dir):
    """Class distribution of labels.quality."""
    return P.class_distribution(table(spark, sf_dir, "labels"), "quality")


@register("class_distribution_priority", _sql_class_distribution("orders", "o_orderpriority"))
def class_distribution_priority(spark, sf_dir):
    """Class distribution of orders.o_orderpriority."""
    return P.class_distribution(table(spark, sf_dir, "orders"), "o_orderpriority")


def _sql_target_summary(source: str, target: str, kind: str) -> str:
    if kind in ("integer", "float"):
        hint = ("CASE WHEN ud < 2 OR nm = 0 THEN 'undetermined' WHEN ud <= least(20, greatest(2, "
                "CAST(floor(sqrt(nm)) AS BIGINT))) THEN 'classification' ELSE 'regression' END")
    else:
        hint = "CASE WHEN ud < 2 OR nm = 0 THEN 'undetermined' ELSE 'classification' END"
    return f"""
SELECT '{target}' AS target, task_hint, nm AS non_missing_count, rows_ - nm AS missing_count,
       ud AS unique_count,
       (task_hint = 'classification' AND ud >= 2 AND CAST(mn AS DOUBLE) / mx < 0.2) AS imbalance_warning,
       (task_hint = 'classification' AND ud > 20) AS distribution_truncated
FROM (SELECT *, {hint} AS task_hint FROM (
  SELECT CAST(coalesce(sum(n) FILTER (WHERE t IS NOT NULL), 0) AS BIGINT) AS nm,
         count(*) FILTER (WHERE t IS NOT NULL) AS ud,
         min(n) FILTER (WHERE t IS NOT NULL) AS mn, max(n) FILTER (WHERE t IS NOT NULL) AS mx,
         CAST(sum(n) AS BIGINT) AS rows_
  FROM (SELECT {target} AS t, count(*) AS n FROM {source} GROUP BY {target})))"""


@register("target_summary_quality", _sql_target_summary("labels", "quality", "integer"))
def target_summary_quality(spark, sf_dir):
    """Labels.quality -> classification, imbalanced (58/341 < 0.2)."""
    return P.target_summary(table(spark, sf_dir, "labels"), "quality")


@register("target_summary_totalprice", _sql_target_summary("orders", "o_totalprice", "float"))
def target_summary_totalprice(spark, sf_dir):
    """Orders.o_totalprice -> regression hint."""
    return P.target_summary(table(spark, sf_dir, "orders"), "o_totalprice")


@register("target_summary_priority", _sql_target_summary("orders", "o_orderpriority", "string"))
def target_summary_priority(spark, sf_dir):
    """Orders.o_orderpriority -> classification, balanced."""
    return P.target_summary(table(spark, sf_dir, "orders"), "o_orderpriority")


# -------------------------------------------------------------- checks (V)


@register(
    "check_target",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE t IS NULL), 0) AS BIGINT) AS missing, "
    "CAST(coalesce(sum(n) FILTER (WHERE t IS NOT NULL AND isinf(t)), 0) AS BIGINT) AS non_finite, "
    "count(*) FILTER (WHERE t IS NOT NULL) AS classes, min(n) FILTER (WHERE t IS NOT NULL) AS min_class_count, "
    "max(n) FILTER (WHERE t IS NOT NULL) AS max_class_count FROM "
    "(SELECT value AS t, count(*) AS n FROM " + EVENTS_DIRTY_SQL + " GROUP BY value)",
)
def check_target(spark, sf_dir):
    """V3-V6/V9: target completeness, finiteness and class counts (events.value)."""
    return V.target_report(events_dirty(spark, sf_dir), "value")


@register(
    "check_stratify",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS non_finite, "
    "count(*) AS classes, min(n) AS min_class_count, max(n) AS max_class_count FROM "
    "(SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus)",
)
def check_stratify(spark, sf_dir):
    """V6/V9: class counts that gate stratification and fold feasibility."""
    return V.target_report(table(spark, sf_dir, "orders"), "o_orderstatus")


@register(
    "check_finite",
    "SELECT part, column_name, count(*) FILTER (WHERE isinf(v)) AS infinite_count FROM ("
    "SELECT s.part, u.column_name, u.v FROM ("
    + sql_stratified(EVENTS_DIRTY_SQL, "event_id", "event_type")
    + ") s, LATERAL (VALUES ('user_id', CAST(s.user_id AS DOUBLE)), ('value', s.value)) u(column_name, v)"
    ") GROUP BY part, column_name",
)
def check_finite(spark, sf_dir):
    """Infinite numeric feature values per partition."""
    split = T.split_dataset(events_dirty(spark, sf_dir), target="event_type", key=["event_id"],
                            task=Task.CLASSIFICATION, config=SplitConfig())
    return V.nonfinite_by_part(split.frame, ["user_id", "value"])


@register(
    "check_marker",
    "SELECT column_name, occurrences FROM (SELECT 'c_mktsegment' AS column_name, "
    "count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS occurrences FROM customer "
    "UNION ALL SELECT 'c_name', count(*) FILTER (WHERE c_name = 'BUILDING') FROM customer)",
)
def check_marker(spark, sf_dir):
    """A fill marker that collides with a real category is detected."""
    return V.marker_collisions(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"], "BUILDING")


# ------------------------------------------------------- features

from pyspark.ml.feature import SQLTransformer  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

from .config import FeatureOverrides, Imputation, PreprocessingConfig  # noqa: E402
from .operators import estimators as E  # noqa: E402
from .operators import features as FE  # noqa: E402
from .operators import metrics as M  # noqa: E402

MARKER = PreprocessingConfig().categorical_fill_value


def _train():
    return F.col("part") == "train"


def _transformed(split_frame, features, config, where=None, overrides=None):
    where = _train() if where is None else where
    schema = FE.infer_feature_schema(split_frame, features, overrides)
    stats = FE.fit_feature_stats(split_frame, schema, config, where=where)
    return stats, SQLTransformer(statement=FE.transform_sql(stats)).transform(split_frame)


def _sql_scaled(expr: str, med: str, mu: str, sd: str) -> str:
    return f"round((coalesce({expr}, {med}) - {mu}) / CASE WHEN {sd} = 0 THEN 1 ELSE {sd} END, 6)"


_EVENTS_MISSING_SPLIT = sql_stratified(EVENTS_MISSING_SQL, "event_id", "event_type")


@register(
    "standardize_events",
    f"""
WITH s AS ({_EVENTS_MISSING_SPLIT}),
m AS (SELECT median(CAST(user_id AS DOUBLE)) AS mu_, median(value) AS mv FROM s WHERE part = 'train'),
st AS (SELECT avg(coalesce(CAST(user_id AS DOUBLE), mu_)) AS cu, stddev_pop(coalesce(CAST(user_id AS DOUBLE), mu_)) AS su,
              avg(coalesce(value, mv)) AS cv, stddev_pop(coalesce(value, mv)) AS sv
       FROM s, m WHERE part = 'train')
SELECT event_id, part, {_sql_scaled('CAST(user_id AS DOUBLE)', 'mu_', 'cu', 'su')} AS numeric__user_id,
       {_sql_scaled('value', 'mv', 'cv', 'sv')} AS numeric__value
FROM s, m, st""",
)
def standardize_events(spark, sf_dir):
    """F4 + F6: train-median imputation then train mean / population-sd scaling."""
    split = T.split_dataset(events_missing(spark, sf_dir), target="event_type", key=["event_id"],
                            task=Task.CLASSIFICATION)
    _, out = _transformed(split.frame, ["user_id", "value"], PreprocessingConfig())
    return out.select("event_id", "part", F.round("numeric__user_id", 6).alias("numeric__user_id"),
                      F.round("numeric__value", 6).alias("numeric__value"))


_ORDERS_MISSING_SQL = (
    "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_totalprice END "
    "AS o_totalprice, o_orderstatus FROM orders)"
)


def orders_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 37 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", "o_custkey", price.alias("o_totalprice"), "o_orderstatus")


@register(
    "impute_mean",
    f"""
WITH s AS ({sql_stratified(_ORDERS_MISSING_SQL, 'o_orderkey', 'o_orderstatus')}),
m AS (SELECT avg(CAST(o_custkey AS DOUBLE)) AS mc, avg(o_totalprice) AS mp FROM s WHERE part = 'train')
SELECT o_orderkey, part, round(coalesce(CAST(o_custkey AS DOUBLE), mc), 6) AS numeric__o_custkey,
       round(coalesce(o_totalprice, mp), 6) AS numeric__o_totalprice FROM s, m""",
)
def impute_mean(spark, sf_dir):
    """F3 + F7: train-mean imputation without scaling."""
    split = T.split_dataset(orders_missing(spark, sf_dir), target="o_orderstatus", key=["o_orderkey"],
                            task=Task.CLASSIFICATION)
    cfg = PreprocessingConfig(numeric_imputation=Imputation.MEAN, scale_numeric=False)
    _, out = _transformed(split.frame, ["o_custkey", "o_totalprice"], cfg)
    return out.select("o_orderkey", "part", F.round("numeric__o_custkey", 6).alias("numeric__o_custkey"),
                      F.round("numeric__o_totalprice", 6).alias("numeric__o_totalprice"))


@register(
    "empty_numeric",
    f"""
WITH s AS ({sql_stratified('(SELECT event_id, CAST(NULL AS DOUBLE) AS empty, value, event_type FROM events)', 'event_id', 'event_type')}),
m AS (SELECT coalesce(median(empty), 0) AS me FROM s WHERE part = 'train'),
st AS (SELECT avg(coalesce(empty, me)) AS ce, stddev_pop(coalesce(empty, me)) AS se FROM s, m WHERE part = 'train')
SELECT event_id, {_sql_scaled('empty', 'me', 'ce', 'se')} AS numeric__empty FROM s, m, st""",
)
def empty_numeric(spark, sf_dir):
    """an all-missing numeric column is kept, filled with 0, scaled by 1."""
    e = table(spark, sf_dir, "events").select(
        "event_id", F.lit(None).cast("double").alias("empty"), "value", "event_type")
    split = T.split_dataset(e, target="event_type", key=["event_id"], task=Task.CLASSIFICATION)
    _, out = _transformed(split.frame, ["empty", "value"], PreprocessingConfig())
    return out.select("event_id", F.round("numeric__empty", 6).alias("numeric__empty"))


_CUSTOMER_CAT_SQL = (
    "(SELECT c_custkey, CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, "
    "c_nationkey, c_acctbal FROM customer)"
)


@register(
    "onehot_long",
    f"""
WITH s AS ({sql_holdout(_CUSTOMER_CAT_SQL, 'c_custkey')}),
tr AS (SELECT * FROM s WHERE part = 'train' AND (c_mktsegment IS NULL OR c_mktsegment <> 'MACHINERY')),
cats AS (SELECT DISTINCT 'c_mktsegment' AS col, coalesce(c_mktsegment, '{MARKER}') AS v FROM tr
         UNION SELECT DISTINCT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM tr)
SELECT s.c_custkey, s.part, 'categorical__c_mktsegment_' || v AS feature FROM s JOIN cats
  ON cats.col = 'c_mktsegment' AND cats.v = coalesce(s.c_mktsegment, '{MARKER}')
UNION ALL
SELECT s.c_custkey, s.part, 'categorical__c_nationkey_' || v FROM s JOIN cats
  ON cats.col = 'c_nationkey' AND cats.v = CAST(s.c_nationkey AS VARCHAR)""",
)
def onehot_long(spark, sf_dir):
    """F2 + F8 + F9 + I4: marker fill, sorted train categories, forced-categorical
    integer, and an all-zero block for a segment never seen in training."""
    c = table(spark, sf_dir, "customer")
    seg = F.when(F.col("c_custkey") % 37 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    frame = T.split_dataset(
        c.select("c_custkey", seg.alias("c_mktsegment"), "c_nationkey", "c_acctbal"),
        target="c_acctbal", key=["c_custkey"], task=Task.REGRESSION).frame
    where = _train() & (F.col("c_mktsegment").isNull() | (F.col("c_mktsegment") != "MACHINERY"))
    schema = FE.infer_feature_schema(frame, ["c_mktsegment", "c_nationkey"],
                                     FeatureOverrides(categorical=("c_nationkey",)))
    stats = FE.fit_feature_stats(frame, schema, PreprocessingConfig(), where=where)
    model = FE.fit_preprocessor(frame.filter(where), stats)
    encoded = model.transform(frame)
    parts = []
    for col in schema.categorical:
        labels = F.array(*[F.lit(v) for v in stats.categories[col]])
        parts.append(
            encoded.select("c_custkey", "part", F.posexplode(vector_to_array(f"categorical__{col}")).alias("i", "x"))
            .filter(F.col("x") != 0)
            .select("c_custkey", "part",
                    F.concat(F.lit(f"categorical__{col}_"), F.element_at(labels, F.col("i") + 1)).alias("feature"))
        )
    return parts[0].unionByName(parts[1])


_ORDERS_MISSING_FOLDS = sql_folds(_ORDERS_MISSING_SQL, "o_orderkey", "o_orderstatus")


@register(
    "fold_local_stats",
    f"""
SELECT CAST(t.fold_number AS INTEGER) AS fold_number, count(*) AS train_rows, count(o_totalprice) AS non_missing,
       round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median,
       round(stddev_pop(o_totalprice), 6) AS std_pop
FROM ({_ORDERS_MISSING_FOLDS}) f, range(1, 6) t(fold_number) WHERE f.fold <> t.fold_number
GROUP BY t.fold_number""",
)
def fold_local_stats(spark, sf_dir):
    """train-side statistics for every fold in one pass."""
    folded = T.assign_folds(orders_missing(spark, sf_dir), target="o_orderstatus", key=["o_orderkey"],
                            config=FoldConfig())
    return FE.fold_local_numeric_stats(folded, "o_totalprice", 5)


@register(
    "fold_fit_stats",
    f"""
WITH tr AS (SELECT CAST(t.fold_number AS INTEGER) AS fold_number, o_totalprice AS x
            FROM ({_ORDERS_MISSING_FOLDS}) f, range(1, 6) t(fold_number) WHERE f.fold <> t.fold_number),
     md AS (SELECT fold_number, median(x) AS m FROM tr GROUP BY fold_number)
SELECT fold_number, count(*) AS training_rows, round(any_value(m), 6) AS fill,
       round(avg(coalesce(x, m)), 6) AS center, round(stddev_pop(coalesce(x, m)), 6) AS scale
FROM tr JOIN md USING (fold_number) GROUP BY fold_number""",
)
def fold_fit_stats(spark, sf_dir):
    """F15 as cross-validation runs it: fill, center and scale of every fold's
    training side, merged from per-fold states."""
    folded = T.assign_folds(orders_missing(spark, sf_dir), target="o_orderstatus", key=["o_orderkey"],
                            config=FoldConfig())
    schema = FE.infer_feature_schema(folded, ["o_totalprice"])
    stats = FE.fit_fold_feature_stats(folded, schema, PreprocessingConfig(), 5)
    rows = [(k, s.training_rows, s.fill["o_totalprice"], s.center["o_totalprice"], s.scale["o_totalprice"])
            for k, s in stats.items()]
    return spark.createDataFrame(
        rows, "fold_number int, training_rows bigint, fill double, center double, scale double")


# ------------------------------------------------- estimators and metrics


def sql_classification_metrics(pred_sql: str, group: list[str]) -> str:
    g = ", ".join(group)
    gc = (g + ", ") if group else ""
    gb = f"GROUP BY {g}" if group else ""
    gl = ("GROUP BY " + g + ", label") if group else "GROUP BY label"
    metric_rows = ", ".join(
        f"('{name}', {name}, {str(hib).lower()})" for name, hib in M.CLASSIFICATION_METRICS
    )
    return f"""
WITH conf AS (SELECT {gc}CAST(actual AS VARCHAR) AS a, CAST(predicted AS VARCHAR) AS p, count(*) AS c
              FROM ({pred_sql}) GROUP BY {gc}a, p),
lab AS (SELECT {gc}label, CAST(sum(sup) AS DOUBLE) AS sup, CAST(sum(pr) AS DOUBLE) AS pr, CAST(sum(tp) AS DOUBLE) AS tp
        FROM (SELECT {gc}a AS label, c AS sup, 0 AS pr, CASE WHEN a = p THEN c ELSE 0 END AS tp FROM conf
              UNION ALL SELECT {gc}p AS label, 0 AS sup, c AS pr, 0 AS tp FROM conf) {gl}),
w AS (SELECT {gc}sum(tp) / sum(sup) AS accuracy,
             avg(CASE WHEN sup > 0 THEN tp / sup END) AS balanced_accuracy,
             avg(CASE WHEN sup + pr > 0 THEN 2.0 * tp / (sup + pr) ELSE 0.0 END) AS f1_macro,
             sum(CASE WHEN sup + pr > 0 THEN 2.0 * tp / (sup + pr) ELSE 0.0 END * sup) / sum(sup) AS f1_weighted,
             avg(CASE WHEN pr > 0 THEN tp / pr ELSE 0.0 END) AS precision_macro,
             avg(CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END) AS recall_macro
      FROM lab {gb})
SELECT {gc}metric, round(CAST(value AS DOUBLE), 6) AS value, higher_is_better
FROM w, LATERAL (VALUES {metric_rows}) v(metric, value, higher_is_better)"""


def sql_regression_metrics(pred_sql: str) -> str:
    return f"""
WITH w AS (SELECT avg(abs(actual - predicted)) AS mean_absolute_error,
                  sqrt(avg((actual - predicted) * (actual - predicted))) AS root_mean_squared_error,
                  sum((actual - predicted) * (actual - predicted)) AS ssr, var_pop(actual) * count(*) AS sst
           FROM ({pred_sql})),
w2 AS (SELECT *, CASE WHEN sst > 0 THEN 1 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM w)
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value, higher_is_better FROM w2,
  LATERAL (VALUES ('mean_absolute_error', mean_absolute_error, false), ('r2', r2, true),
                  ('root_mean_squared_error', root_mean_squared_error, false)) v(metric, value, higher_is_better)"""


# Fixed rule used only to produce a prediction column for the metric checks.
_RULE_SQL = (
    "SELECT l_returnflag AS actual, CASE WHEN l_quantity <= 16 THEN 'A' WHEN l_quantity <= 33 "
    "THEN 'N' ELSE 'R' END AS predicted FROM lineitem"
)


def lineitem_rule_predictions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pred = F.when(F.col("l_quantity") <= 16, "A").when(F.col("l_quantity") <= 33, "N").otherwise("R")
    return li.select(F.col("l_returnflag").alias("actual"), pred.alias("predicted"))


@register("metrics_classification", sql_classification_metrics(_RULE_SQL, []))
def metrics_classification(spark, sf_dir):
    """M1-M6 over a whole-table prediction column (lineitem return flag)."""
    return M.classification_metrics(lineitem_rule_predictions(spark, sf_dir))


@register(
    "confusion",
    f"SELECT CAST(actual AS VARCHAR) AS actual, CAST(predicted AS VARCHAR) AS predicted, count(*) AS count "
    f"FROM ({_RULE_SQL}) GROUP BY 1, 2",
)
def confusion(spark, sf_dir):
    """Confusion table."""
    return M.confusion_table(lineitem_rule_predictions(spark, sf_dir), [])


_EVENTS_SPLIT = sql_stratified("(SELECT event_id, user_id, value, event_type FROM events)", "event_id", "event_type")
_DUMMY_SQL = f"""
WITH s AS ({_EVENTS_SPLIT}),
maj AS (SELECT event_type AS label FROM s WHERE part = 'train' GROUP BY event_type
        ORDER BY count(*) DESC, event_type ASC LIMIT 1)
SELECT event_id, event_type AS actual, label AS prediction FROM s, maj WHERE part = 'validation'"""


def _dummy_events(spark, sf_dir):
    split = T.split_dataset(
        table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type"),
        target="event_type", key=["event_id"], task=Task.CLASSIFICATION)
    schema = FE.infer_feature_schema(split.frame, ["user_id", "value"])
    stats = FE.fit_feature_stats(split.frame, schema, where=_train())
    fitted = E.fit_estimator(split.train(), stats, target="event_type", estimator=E.DUMMY_CLASSIFIER,
                             task=Task.CLASSIFICATION, seed=42, key=["event_id"])
    return E.predict(fitted, split.validation(), ["event_id", "event_type"]).withColumnRenamed(
        "event_type", "actual")


@register("dummy_predict", _DUMMY_SQL)
def dummy_predict(spark, sf_dir):
    """E1 + E8: prior dummy classifier fitted on train, scored on validation."""
    return _dummy_events(spark, sf_dir)


@register(
    "dummy_metrics",
    sql_classification_metrics(f"SELECT actual, prediction AS predicted FROM ({_DUMMY_SQL})", []),
)
def dummy_metrics(spark, sf_dir):
    """R1 evaluation step: holdout metrics of the dummy classifier."""
    return M.classification_metrics(_dummy_events(spark, sf_dir).withColumnRenamed("prediction", "predicted"))


_PRIORITY_FOLDS = sql_folds("(SELECT o_orderkey, o_orderpriority FROM orders)", "o_orderkey", "o_orderpriority")
_DUMMY_CV_PRED = f"""
WITH f AS ({_PRIORITY_FOLDS}),
cc AS (SELECT fold, o_orderpriority AS c, count(*) AS n FROM f GROUP BY fold, o_orderpriority),
tot AS (SELECT c, sum(n) AS t FROM cc GROUP BY c),
tr AS (SELECT k.fold_number, tot.c, tot.t - coalesce(cc.n, 0) AS n FROM range(1, 6) k(fold_number)
       CROSS JOIN tot LEFT JOIN cc ON cc.fold = k.fold_number AND cc.c = tot.c),
maj AS (SELECT fold_number, c FROM (SELECT *, row_number() OVER (PARTITION BY fold_number ORDER BY n DESC, c ASC) AS r
        FROM tr) WHERE r = 1)
SELECT CAST(f.fold AS INTEGER) AS fold, f.o_orderpriority AS actual, maj.c AS predicted FROM f JOIN maj ON f.fold = maj.fold_number"""


def _priority_folds(spark, sf_dir):
    return T.assign_folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"),
                          target="o_orderpriority", key=["o_orderkey"], config=FoldConfig())


@register("dummy_cv_metrics", sql_classification_metrics(_DUMMY_CV_PRED, ["fold"]))
def dummy_cv_metrics(spark, sf_dir):
    """Per-fold metrics of the dummy classifier, all folds in one query."""
    return M.classification_metrics(E.dummy_fold_predictions(_priority_folds(spark, sf_dir), "o_orderpriority", 5),
                                    ["fold"])


@register(
    "dummy_cv_summary",
    "SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS standard_deviation, "
    "count(*) AS fold_count FROM (" + sql_classification_metrics(_DUMMY_CV_PRED, ["fold"]) + ") GROUP BY metric",
)
def dummy_cv_summary(spark, sf_dir):
    """C4: mean and population sd of each metric over folds."""
    from .operators import ranking as RK

    per_fold = M.classification_metrics(
        E.dummy_fold_predictions(_priority_folds(spark, sf_dir), "o_orderpriority", 5), ["fold"])
    return RK.fold_summaries(per_fold.withColumn("estimator", F.lit(E.DUMMY_CLASSIFIER))).select(
        "metric", "mean", "standard_deviation", "fold_count")


_PART_SPLIT = sql_holdout("(SELECT p_partkey, p_size, p_retailprice FROM part)", "p_partkey")
_RIDGE_SQL = f"""
WITH s AS ({_PART_SPLIT}),
m AS (SELECT median(CAST(p_size AS DOUBLE)) AS med FROM s WHERE part = 'train'),
st AS (SELECT avg(coalesce(CAST(p_size AS DOUBLE), med)) AS mu, stddev_pop(coalesce(CAST(p_size AS DOUBLE), med)) AS sd
       FROM s, m WHERE part = 'train'),
xs AS (SELECT s.*, (coalesce(CAST(p_size AS DOUBLE), med) - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS x FROM s, m, st),
fit AS (SELECT regr_sxy(p_retailprice, x) / (regr_sxx(p_retailprice, x) + 1.0) AS slope,
               avg(p_retailprice) AS ybar, avg(x) AS xbar FROM xs WHERE part = 'train')
SELECT p_partkey, p_retailprice AS actual, ybar + slope * (x - xbar) AS prediction FROM xs, fit WHERE part = 'validation'"""


def _ridge_part(spark, sf_dir):
    split = T.split_dataset(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"),
                            target="p_retailprice", key=["p_partkey"], task=Task.REGRESSION)
    schema = FE.infer_feature_schema(split.frame, ["p_size"])
    stats = FE.fit_feature_stats(split.frame, schema, where=_train())
    fitted = E.fit_estimator(split.train(), stats, target="p_retailprice", estimator=E.RIDGE_REGRESSION,
                             task=Task.REGRESSION, seed=42, key=["p_partkey"])
    return E.predict(fitted, split.validation(), ["p_partkey", "p_retailprice"]).withColumnRenamed(
        "p_retailprice", "actual")


@register("ridge_one_feature", f"SELECT p_partkey, round(prediction, 6) AS prediction FROM ({_RIDGE_SQL})")
def ridge_one_feature(spark, sf_dir):
    """Ridge (alpha 1, unpenalised intercept) equals the closed form."""
    return _ridge_part(spark, sf_dir).select("p_partkey", F.round("prediction", 6).alias("prediction"))


@register("metrics_regression", sql_regression_metrics(f"SELECT actual, prediction AS predicted FROM ({_RIDGE_SQL})"))
def metrics_regression(spark, sf_dir):
    """M7-M9 on the ridge validation predictions."""
    return M.regression_metrics(_ridge_part(spark, sf_dir).withColumnRenamed("prediction", "predicted"))


@register(
    "category_ranks",
    "SELECT column_name, value, count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS rank "
    "FROM (SELECT unnest(['l_orderkey', 'l_partkey', 'l_returnflag', 'l_linestatus']) AS column_name, "
    "unnest([CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag, l_linestatus]) AS value "
    "FROM lineitem) GROUP BY column_name, value",
)
def category_ranks(spark, sf_dir):
    """the stored dictionary of four lineitem columns, ranks from
    range partitions."""
    from .operators.dictionary import build_dictionary

    columns = ["l_orderkey", "l_partkey", "l_returnflag", "l_linestatus"]
    return build_dictionary(table(spark, sf_dir, "lineitem"), columns, MARKER).table(spark)


_ORDERS_SPLIT = sql_holdout("(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)", "o_orderkey")


@register(
    "ridge_wide_categories",
    f"""
WITH s AS ({_ORDERS_SPLIT}),
c AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS m FROM s WHERE part = 'train' GROUP BY o_custkey),
i AS (SELECT sum(total / (m + 1)) / sum(m / (m + 1)) AS b FROM c)
SELECT o_orderkey, round(b + coalesce((total - m * b) / (m + 1), 0), 6) AS prediction
FROM s LEFT JOIN c USING (o_custkey), i WHERE part = 'validation'""",
)
def ridge_wide_categories(spark, sf_dir):
    """F9 + E4 + I4: ridge on one dictionary-encoded column, against its closed
    form; customers without training orders add nothing."""
    split = T.split_dataset(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
                            target="o_totalprice", key=["o_orderkey"], task=Task.REGRESSION)
    schema = FE.infer_feature_schema(split.frame, ["o_custkey"], FeatureOverrides(categorical=("o_custkey",)))
    stats = FE.fit_feature_stats(split.frame, schema, where=_train(), list_limit=0)
    fitted = E.fit_estimator(split.train(), stats, target="o_totalprice", estimator=E.RIDGE_REGRESSION,
                             task=Task.REGRESSION, seed=42, key=["o_orderkey"])
    return E.predict(fitted, split.validation(), ["o_orderkey"])


@register(
    "scored_parts",
    _RIDGE_SQL.replace("SELECT p_partkey, p_retailprice AS actual, ybar + slope * (x - xbar) AS prediction FROM xs, fit "
                       "WHERE part = 'validation'",
                       "SELECT p_partkey, round(ybar + slope * (x - xbar), 6) AS prediction FROM xs, fit"),
)
def scored_parts(spark, sf_dir):
    """I1 + V15 + V16: every part scored and checked in one pass, read back
    from the committed folder."""
    import uuid

    from .plans.artifacts import Artifact, feature_contract
    from .plans.scoring import score_table
    from .session import checkpoint_dir

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    split = T.split_dataset(parts, target="p_retailprice", key=["p_partkey"], task=Task.REGRESSION)
    stats = FE.fit_feature_stats(split.frame, FE.infer_feature_schema(split.frame, ["p_size"]), where=_train())
    fitted = E.fit_estimator(split.train(), stats, target="p_retailprice", estimator=E.RIDGE_REGRESSION,
                             task=Task.REGRESSION, seed=42, key=["p_partkey"])
    artifact = Artifact({"features": feature_contract(parts, stats),
                         "categorical_fill_value": stats.config.categorical_fill_value}, fitted.model)
    path = f"{checkpoint_dir(spark)}/tessera-scored/{uuid.uuid4().hex}"
    score_table(artifact, parts.drop("p_retailprice"), path, key=["p_partkey"])
    return spark.read.parquet(path)


# ------------------------------------ model runs (rows-only: iterative fits)

from .functions.digest import multiset_digest, value_token  # noqa: E402
from .plans import benchmark as B  # noqa: E402
from .plans import crossval as CV  # noqa: E402
from .plans import final as G  # noqa: E402
from .plans.train import TrainingConfig, train  # noqa: E402


def _run_metrics(spark, df, target, key, task, estimator):
    result = train(df, TrainingConfig(task, estimator), target=target, key=key)
    return spark.createDataFrame(
        [(m["name"], m["value"], m["higher_is_better"]) for m in result.record["metrics"]],
        "metric string, value double, higher_is_better boolean")


def _sql_solved(name: str, matrix: str) -> str:
    """CTEs that solve a linear system by Gauss-Jordan steps: ``matrix`` has
    rows (i, j, v) with i from 1 to n and the right-hand side as j = n + 1;
    ``name`` gets the solution as rows (i, v)."""
    return f"""
{name}_rows AS (SELECT i, list(v ORDER BY j) AS r FROM ({matrix}) GROUP BY i),
{name}_step(k, n, m) AS (
  SELECT 1, CAST(count(*) AS INTEGER), list(r ORDER BY i) FROM {name}_rows
  UNION ALL
  SELECT k + 1, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 2), lambda j:
    CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))
  FROM {name}_step WHERE k <= n),
{name} AS (SELECT unnest(range(1, n + 1)) AS i, unnest(list_transform(m, lambda r: r[n + 1])) AS v
           FROM {name}_step WHERE k = n + 1)"""


def _sql_scaled_rows(split: str, columns: list[str]) -> str:
    """CTE ``z``: the split rows with every numeric column filled with its
    training median and scaled by the training mean and deviation."""
    stats = ", ".join(f"median(CAST({c} AS DOUBLE)) AS d_{c}" for c in columns)
    moments = ", ".join(f"avg(coalesce(CAST({c} AS DOUBLE), d_{c})) AS m_{c}, "
                        f"stddev_pop(coalesce(CAST({c} AS DOUBLE), d_{c})) AS s_{c}" for c in columns)
    scaled = ", ".join(f"(coalesce(CAST({c} AS DOUBLE), d_{c}) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END "
                       f"AS z_{c}" for c in columns)
    return f"""
sp AS MATERIALIZED ({split}),
md AS (SELECT {stats} FROM sp WHERE part = 'train'),
mo AS (SELECT {moments} FROM sp, md WHERE part = 'train'),
z AS MATERIALIZED (SELECT sp.*, {scaled} FROM sp, md, mo)"""


def _sql_logistic(split: str, columns: list[str], target: str, classes: int, steps: int = 9) -> str:
    """(actual, predicted) of the validation rows by multinomial logistic
    regression with C = 1: Newton steps from zero, each solved in SQL."""
    width = len(columns) + 1
    n = classes * width  # unknown a = (class - 1) * width + feature, the intercept last
    z = ", ".join(f"z_{c}" for c in columns)
    parts = [_sql_scaled_rows(split, columns), f"""
cl AS (SELECT {target} AS label, row_number() OVER (ORDER BY {target}) AS c FROM (SELECT DISTINCT {target} FROM z
       WHERE part = 'train')),
x AS MATERIALIZED (SELECT row_number() OVER () AS id, [{z}, 1.0] AS x, c AS y FROM z JOIN cl ON label = {target}
                   WHERE part = 'train'),
size AS (SELECT count(*) AS n FROM x),
t0 AS (SELECT unnest(range(1, {n + 1})) AS i, 0.0 AS v)"""]
    for s in range(steps):
        parts.append(f"""
w{s} AS (SELECT list(v ORDER BY i) AS t FROM t{s}),
e{s} AS (SELECT id, x, y, list_transform(range({classes}), lambda k: exp(list_sum(list_transform(range(1, {width + 1}),
         lambda f: x[f] * t[k * {width} + f])))) AS e FROM x, w{s}),
p{s} AS MATERIALIZED (SELECT id, x, y, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e{s}),
g{s} AS (SELECT a AS i, sum(x[(a - 1) % {width} + 1] * (p[(a - 1) // {width} + 1] - CASE WHEN y = (a - 1) // {width} + 1
         THEN 1 ELSE 0 END)) + any_value(CASE WHEN a % {width} = 0 THEN 0 ELSE t[a] END) AS v
         FROM p{s}, w{s}, range(1, {n + 1}) r(a) GROUP BY a),
h{s} AS (SELECT a AS i, b AS j, sum(x[(a - 1) % {width} + 1] * x[(b - 1) % {width} + 1] * p[(a - 1) // {width} + 1]
         * (CASE WHEN (a - 1) // {width} = (b - 1) // {width} THEN 1 ELSE 0 END - p[(b - 1) // {width} + 1]))
         + any_value(CASE WHEN a = b AND a % {width} <> 0 THEN 1.0 WHEN a % {width} = 0 AND b % {width} = 0
                     THEN CAST(n AS DOUBLE) / {classes} ELSE 0.0 END) AS v
         FROM p{s}, size, range(1, {n + 1}) r(a), range(1, {n + 1}) q(b) GROUP BY a, b),
{_sql_solved(f"s{s}", f"SELECT i, j, v FROM h{s} UNION ALL SELECT i, {n + 1}, v FROM g{s}")},
t{s + 1} AS (SELECT i, t.v - d.v AS v FROM t{s} t JOIN s{s} d USING (i))""")
    score = (f"list_transform(range({classes}), lambda k: list_sum(list_transform(range(1, {width + 1}), "
             f"lambda f: [{z}, 1.0][f] * t[k * {width} + f])))")
    return f"""WITH RECURSIVE {",".join(parts)},
last AS (SELECT list(v ORDER BY i) AS t FROM t{steps}),
scored AS (SELECT {target} AS actual, {score} AS m FROM z, last WHERE part = 'validation')
SELECT actual, label AS predicted FROM scored JOIN cl ON c = list_position(m, list_max(m))"""


def _sql_ridge(split: str, columns: list[str], categorical: list[str], target: str) -> str:
    """(actual, predicted) of the validation rows by ridge regression with
    alpha = 1: the centred normal equations, solved in SQL."""
    flags = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS col, CAST({c} AS VARCHAR) AS val FROM z WHERE part = 'train'"
                               for c in categorical)
    z = ", ".join(f"z_{c}" for c in columns)
    held = " UNION ALL ".join(f"SELECT id, part, y, '{c}' AS col, CAST({c} AS VARCHAR) AS val FROM r" for c in categorical)
    return f"""WITH RECURSIVE {_sql_scaled_rows(split, columns)},
r AS MATERIALIZED (SELECT row_number() OVER () AS id, {target} AS y, [{z}] AS x, * FROM z),
flag AS (SELECT col, val, {len(columns)} + row_number() OVER (ORDER BY col, val) AS i FROM ({flags})),
held AS MATERIALIZED (
  SELECT id, part, y, i, x[i] AS v FROM r, range(1, {len(columns) + 1}) k(i)
  UNION ALL SELECT id, part, y, i, 1.0 FROM ({held}) JOIN flag USING (col, val)),
size AS (SELECT count(*) AS n, avg(y) AS y FROM r WHERE part = 'train'),
mean AS (SELECT i, sum(v) / any_value(n) AS m FROM held, size WHERE part = 'train' GROUP BY i),
unknown AS (SELECT i FROM mean),
gram AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM held a JOIN held b ON a.id = b.id
         WHERE a.part = 'train' GROUP BY ALL),
full_ AS (SELECT a.i, b.i AS j, coalesce(v, 0) - n * a.m * b.m + CASE WHEN a.i = b.i THEN 1 ELSE 0 END AS v
          FROM mean a CROSS JOIN mean b CROSS JOIN size LEFT JOIN gram g ON g.i = a.i AND g.j = b.i
          UNION ALL
          SELECT i, (SELECT count(*) + 1 FROM unknown), sum(v * (held.y - size.y)) FROM held, size
          WHERE part = 'train' GROUP BY i),
{_sql_solved("w", "SELECT i, j, v FROM full_")},
base AS (SELECT any_value(size.y) - sum(w.v * m) AS b FROM w JOIN mean USING (i), size)
SELECT any_value(h.y) AS actual, sum(h.v * w.v) + any_value(b) AS predicted
FROM held h JOIN w ON h.i = w.i, base WHERE part = 'validation' GROUP BY id"""


_CUSTOMER_SPLIT = sql_stratified("(SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM customer)", "c_custkey",
                                 "c_mktsegment")


@register("logistic_regression_run", sql_classification_metrics(
    _sql_logistic(_CUSTOMER_SPLIT, ["c_custkey", "c_acctbal", "c_nationkey"], "c_mktsegment", 5), []))
def logistic_regression_run(spark, sf_dir):
    """E2 + R1: logistic regression run on customer segments (metrics rows),
    against Newton steps in SQL."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return _run_metrics(spark, c, "c_mktsegment", ["c_custkey"], Task.CLASSIFICATION, E.LOGISTIC_REGRESSION)


@register("forest_classifier_run")
def forest_classifier_run(spark, sf_dir):
    """E3 + R1: random-forest classifier run on order status (metrics rows)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return _run_metrics(spark, o, "o_orderstatus", ["o_orderkey"], Task.CLASSIFICATION,
                        E.RANDOM_FOREST_CLASSIFIER)


_LINEITEM_SPLIT = sql_holdout(
    "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, "
    "l_linestatus, l_extendedprice FROM lineitem)", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice")


@register("ridge_regression_run", sql_regression_metrics(_sql_ridge(
    _LINEITEM_SPLIT, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"],
    ["l_returnflag", "l_linestatus"], "l_extendedprice")))
def ridge_regression_run(spark, sf_dir):
    """E4 + R1: ridge on lineitem price with numeric and categorical features."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_extendedprice")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return _run_metrics(spark, li, "l_extendedprice", key, Task.REGRESSION, E.RIDGE_REGRESSION)


@register("forest_regressor_run")
def forest_regressor_run(spark, sf_dir):
    """E5 + R1: random-forest regressor on part retail price."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return _run_metrics(spark, p, "p_retailprice", ["p_partkey"], Task.REGRESSION, E.RANDOM_FOREST_REGRESSOR)


@register("benchmark_holdout")
def benchmark_holdout(spark, sf_dir):
    """Dummy / logistic / forest leaderboard on one shared events split."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    result = B.benchmark(e, B.BenchmarkConfig(), target="event_type", key=["event_id"])
    return result.leaderboard.select("estimator", "status", "rank", F.round("value", 6).alias("value"))


def _customer_cv(spark, sf_dir, estimators=E.DEFAULT_CLASSIFIERS, k=5):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    cfg = CV.CrossValidationConfig(estimators=estimators, folds=FoldConfig(fold_count=k))
    return c, CV.cross_validate(c, cfg, target="c_mktsegment", key=["c_custkey"])


@register("cross_validate")
def cross_validate(spark, sf_dir):
    """5-fold stratified leaderboard of the three classifiers."""
    _, result = _customer_cv(spark, sf_dir)
    return result.leaderboard


@register("final_fit_score")
def final_fit_score(spark, sf_dir):
    """G1-G5 + I1: refit the CV winner on all rows, score every customer."""
    from .plans.artifacts import Artifact, feature_contract
    from .plans.scoring import predict_frame

    c, result = _customer_cv(spark, sf_dir, (E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION), 3)
    final = G.fit_selected_model(c, result.record, target="c_mktsegment", key=["c_custkey"])
    meta = {"features": feature_contract(c, final.stats),
            "categorical_fill_value": final.stats.config.categorical_fill_value}
    artifact = Artifact(meta, final.model.model)
    return predict_frame(artifact, c.drop("c_mktsegment"), key=["c_custkey"])


_REFIT = CV.CrossValidationConfig(
    estimators=(E.DUMMY_CLASSIFIER, E.LOGISTIC_REGRESSION), folds=FoldConfig(fold_count=3),
    preprocessing=PreprocessingConfig(Imputation.MEAN, scale_numeric=True),
    overrides=FeatureOverrides(categorical=("c_nationkey",)))


@register(
    "final_fit_stats",
    """
SELECT 'c_acctbal' AS column_name, 'numeric' AS role, round(avg(x), 6) AS fill, round(avg(coalesce(x, m)), 6) AS center,
       round(stddev_pop(coalesce(x, m)), 6) AS scale, CAST(NULL AS BIGINT) AS categories
FROM (SELECT x, avg(x) OVER () AS m FROM (
  SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS x FROM customer))
UNION ALL SELECT 'c_nationkey', 'categorical', NULL, NULL, NULL, count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_name', 'categorical', NULL, NULL, NULL, count(DISTINCT c_name) FROM customer""",
)
def final_fit_stats(spark, sf_dir):
    """Statistics of the all-row refit, with the mean imputation and
    the forced role that the cross-validation record carries."""
    c = table(spark, sf_dir, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")))
    record = CV.cross_validate(c, _REFIT, target="c_mktsegment", key=["c_custkey"]).record
    stats = G.fit_selected_model(c, record, target="c_mktsegment", key=["c_custkey"]).stats
    rows = [(n, "numeric", stats.fill[n], stats.center[n], stats.scale[n], None)
            for n in stats.schema.numeric if n != "c_custkey"]
    rows += [(n, "categorical", None, None, None, stats.category_count(n)) for n in stats.schema.categorical]
    return spark.createDataFrame(
        rows, "column_name string, role string, fill double, center double, scale double, categories bigint")


# ------------------------------------------------------ digests

_ORDERS_TOKEN_SQL = " || ".join(sql_framed(x) for x in (
    "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", sql_exact_text("o_totalprice"),
    "CAST(epoch_us(o_orderdate) AS VARCHAR)", "o_orderpriority"))


@register("dataset_digest",
          f"SELECT count(*) AS row_count, {sql_digest(_ORDERS_TOKEN_SQL)} AS digest FROM orders")
def dataset_digest(spark, sf_dir):
    """Order-insensitive content fingerprint of orders."""
    o = table(spark, sf_dir, "orders")
    return multiset_digest(o, value_token(o))


_DOCUMENTS_TOKEN_SQL = " || ".join(sql_framed(x) for x in (
    "CAST(doc_id AS VARCHAR)", "text", "lang", "source", "CAST(n_chars AS VARCHAR)"))


@register("multiline_csv_digest",
          f"SELECT count(*) AS row_count, {sql_digest(_DOCUMENTS_TOKEN_SQL)} AS digest FROM documents")
def multiline_csv_digest(spark, sf_dir):
    """S1 + S5: all documents, with their quotes and line breaks, written to
    CSV and read back from many blocks of few files."""
    import uuid

    from .session import checkpoint_dir
    from .sources.csv import CsvOptions

    docs = table(spark, sf_dir, "documents")
    path = f"{checkpoint_dir(spark)}/tessera-csv/{uuid.uuid4().hex}"
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = CsvOptions(encoding="utf-8", multiline=True).rows(spark, path, docs.columns, docs.schema, mode="FAILFAST")
    back = back.select(*docs.columns)
    return multiset_digest(back, value_token(back))


_ALTERED_SQL = (
    "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 1000 = 1 THEN o_totalprice + 1 "
    "ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"
)


@register(
    "identity_mismatch",
    f"""
SELECT field FROM (
  SELECT 'fingerprint' AS field, (SELECT {sql_digest(_ORDERS_TOKEN_SQL)} FROM orders) AS a,
         (SELECT {sql_digest(_ORDERS_TOKEN_SQL)} FROM {_ALTERED_SQL}) AS b
  UNION ALL SELECT 'row_count', (SELECT CAST(count(*) AS VARCHAR) FROM orders),
         (SELECT CAST(count(*) AS VARCHAR) FROM {_ALTERED_SQL})
) WHERE a <> b""",
)
def identity_mismatch(spark, sf_dir):
    """Fields that differ between orders and a copy with altered prices."""
    o = table(spark, sf_dir, "orders")
    altered = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1000 == 1, F.col("o_totalprice") + 1)
                           .otherwise(F.col("o_totalprice")))
    expected = G.dataset_identity(o, "o_orderstatus")
    fields = G.mismatched_fields(altered, "o_orderstatus", expected)
    return spark.createDataFrame([(f,) for f in fields], "field string")


@register(
    "identity_mismatch_columns",
    "SELECT 'fingerprint' AS field FROM orders HAVING count(*) > 0",
)
def identity_mismatch_columns(spark, sf_dir):
    """The same values under another column name are another dataset."""
    o = table(spark, sf_dir, "orders")
    expected = G.dataset_identity(o, "o_orderstatus")
    fields = G.mismatched_fields(o.withColumnRenamed("o_custkey", "o_clerk"), "o_orderstatus", expected)
    return spark.createDataFrame([(f,) for f in fields], "field string")


@register(
    "fold_plan_audit",
    "SELECT count(*) = 5 AS fold_count_ok, min(fold_number) = 1 AS starts_at_one, max(fold_number) = 5 AS ends_at_k, "
    "count(DISTINCT partition_sha256) = count(*) AS unique_digests, "
    "sum(validation_rows) = (SELECT count(*) FROM orders) AS validation_covers_rows, "
    "count(*) FILTER (WHERE train_rows + validation_rows <> (SELECT count(*) FROM orders)) = 0 AS every_fold_covers_rows "
    "FROM (" + sql_fold_snapshots(_ORDERS_FOLDS_SQL, "o_orderkey") + ")",
)
def fold_plan_audit(spark, sf_dir):
    """The fold plan covers every row once and has k distinct folds."""
    from .operators import ranking as RK

    folded = orders_folds(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").count()
    return RK.fold_plan_audit(T.fold_snapshots(folded, ["o_orderkey"], 5), rows, 5)


def _sql_profile_warnings() -> str:
    src = EVENTS_DIRTY_SQL
    cols = ["event_id", "user_id", "event_type", "value"]
    ident = [c for c in cols if identifier_name(c)]
    parts = [
        f"SELECT 1 AS o, CASE WHEN n > 0 THEN 'Dataset contains ' || CAST(n AS VARCHAR) || ' missing cells.' END AS w "
        f"FROM (SELECT count(*) FILTER (WHERE value IS NULL) + count(*) FILTER (WHERE event_id IS NULL) "
        f"+ count(*) FILTER (WHERE user_id IS NULL) + count(*) FILTER (WHERE event_type IS NULL) AS n FROM {src})",
        f"SELECT 2, CASE WHEN d > 0 THEN 'Dataset contains ' || CAST(d AS VARCHAR) || ' duplicate rows.' END "
        f"FROM (SELECT coalesce(sum(c - 1), 0) AS d FROM (SELECT count(*) AS c FROM {src} "
        f"GROUP BY event_id, user_id, event_type, value))",
        "SELECT 3, CASE WHEN names <> '' THEN 'Constant columns: ' || names || '.' END FROM (SELECT concat_ws(', ', "
        + ", ".join(f"CASE WHEN count(DISTINCT {c}) <= 1 THEN '{c}' END" for c in cols) + f") AS names FROM {src})",
        "SELECT 4, CASE WHEN names <> '' THEN 'High-cardinality columns: ' || names || '.' END FROM (SELECT "
        "concat_ws(', ', CASE WHEN count(DISTINCT event_type) >= 50 AND CAST(count(DISTINCT event_type) AS DOUBLE) "
        f"/ count(event_type) >= 0.5 THEN 'event_type' END) AS names FROM {src})",
        "SELECT 5, CASE WHEN names <> '' THEN 'Likely identifier columns: ' || names || '.' END FROM (SELECT "
        "concat_ws(', ', " + ", ".join(
            f"CASE WHEN count({c}) = count(*) AND count(DISTINCT {c}) = count(*) THEN '{c}' END" for c in ident)
        + f") AS names FROM {src})",
        "SELECT 6, CASE WHEN names <> '' THEN 'Columns containing infinite values: ' || names || '.' END FROM "
        f"(SELECT concat_ws(', ', CASE WHEN count(*) FILTER (WHERE isinf(value)) > 0 THEN 'value' END) AS names FROM {src})",
        f"SELECT 7, CASE WHEN count(*) FILTER (WHERE event_type IS NULL) > 0 THEN "
        f"'Target column ''event_type'' contains missing values.' END FROM {src}",
        "SELECT 8, CASE WHEN count(*) >= 2 AND CAST(min(n) AS DOUBLE) / max(n) < 0.2 THEN "
        "'Target column ''event_type'' appears imbalanced.' END FROM (SELECT count(*) AS n FROM "
        f"{src} WHERE event_type IS NOT NULL GROUP BY event_type)",
        "SELECT 9, CASE WHEN count(DISTINCT event_type) < 2 THEN "
        f"'Task type could not be inferred from target column ''event_type''.' END FROM {src}",
    ]
    return ("SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS position, w AS warning FROM ("
            + " UNION ALL ".join(parts) + ") WHERE w IS NOT NULL")


@register("profile_warnings", _sql_profile_warnings())
def profile_warnings(spark, sf_dir):
    """The ordered advisory messages of a full profile (events with gaps)."""
    prof = P.profile_dataset(events_dirty(spark, sf_dir), "event_type")
    return spark.createDataFrame([(i + 1, w) for i, w in enumerate(prof.warnings)],
                                 "position int, warning string")


@register(
    "prediction_row_numbers",
    f"SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS row_number, prediction "
    f"FROM ({_DUMMY_SQL})",
)
def prediction_row_numbers(spark, sf_dir):
    """1-based row numbers of scored rows in key order, without a global window."""
    from .plans.scoring import number_rows

    return number_rows(_dummy_events(spark, sf_dir).select("event_id", "prediction"), ["event_id"])


@register(
    "prediction_sanity",
    f"SELECT count(*) AS rows, count(*) FILTER (WHERE prediction IS NULL OR isnan(prediction) "
    f"OR isinf(prediction)) AS invalid_predictions FROM ({_RIDGE_SQL})",
)
def prediction_sanity(spark, sf_dir):
    """One finite prediction per scored row."""
    return V.prediction_sanity(_ridge_part(spark, sf_dir))
