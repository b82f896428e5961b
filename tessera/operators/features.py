"""Feature roles and leakage-safe preprocessing.

Statistics are learned from training rows only, as Column aggregations,
and then frozen into a persistable ``pyspark.ml`` pipeline:

* ``SQLTransformer``: numeric imputation + standard scaling with the
  learned literals, categorical cast + constant fill (codegen, JVM-side);
* ``StringIndexerModel.from_labels`` (sorted train categories, unseen ->
  extra index) + ``OneHotEncoder(dropLast=True)``: unseen categories become
  an all-zero block, no train category is dropped;
* ``VectorAssembler``: numeric block then categorical block.

Spark's ``Imputer`` (approximate median, fails on all-NULL columns) and
``StandardScaler`` (sample sd) do not match the required semantics, hence
the literal statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureOverrides, Imputation, PreprocessingConfig, PreprocessingError
from ..functions.columns import as_double, is_infinite, is_numeric_type, kind_of
from ..functions.schema import schema_diff
from .dictionary import Dictionary, build_dictionary, category, feature_positions
from .quantile import column_medians, fold_medians

FEATURES_COL = "features"
#: Distinct values of all categorical columns that are kept as lists; columns
#: with more than their share of these are encoded by a stored dictionary.
LIST_CATEGORIES = 100_000


@dataclass(frozen=True)
class FeatureSchema:
    all_features: tuple[str, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]


# Role by column kind; kinds without a role need explicit feature engineering.
ROLE_OF_KIND = {"integer": "numeric", "float": "numeric", "boolean": "categorical", "string": "categorical"}


def infer_feature_schema(
    df: DataFrame, features: list[str], overrides: FeatureOverrides | None = None
) -> FeatureSchema:
    """a role for every feature, from its override or else its type.

    All problems are reported at once: no, blank, repeated or unknown names,
    overrides of columns that are not features, numeric overrides of columns
    that are not numeric, and types without a role.
    """
    given = (overrides or FeatureOverrides()).roles()
    types = dict(zip(df.columns, (f.dataType for f in df.schema.fields)))
    problems = ["no features are given"] if not features else []
    names = schema_diff(features)
    problems += names.problems()
    problems += [f"unknown feature {n!r}" for n in features if n not in types]
    problems += [f"override of unknown feature {n!r}" for n in given if n not in features]
    roles = {}
    for name in (n for n in features if n in types):
        dtype = types[name]
        roles[name] = given.get(name) or ROLE_OF_KIND.get(kind_of(dtype))
        if roles[name] is None:
            problems.append(f"Unsupported type {dtype.simpleString()} of {name!r}: derive numeric or text columns")
        elif given.get(name) == "numeric" and not is_numeric_type(dtype):
            problems.append(f"{name!r} was forced numeric but has type {dtype.simpleString()}")
    if problems:
        raise PreprocessingError("Features: " + "; ".join(problems) + ".")
    held = lambda role: tuple(n for n in features if roles[n] == role)
    return FeatureSchema(tuple(features), held("numeric"), held("categorical"))


@dataclass
class FeatureStats:
    """Learned preprocessing state (small; literals of the fitted pipeline)."""

    schema: FeatureSchema
    config: PreprocessingConfig
    fill: dict[str, float] = field(default_factory=dict)
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    training_rows: int = 0
    dictionary: Dictionary | None = None
    rank: str = "rank"

    @property
    def listed(self) -> list[str]:
        """Categorical columns whose values are kept as lists."""
        return [c for c in self.schema.categorical if c in self.categories]

    @property
    def wide(self) -> list[str]:
        """Categorical columns encoded by the dictionary, after the others."""
        return [c for c in self.schema.categorical if c not in self.categories]

    @property
    def list_width(self) -> int:
        return len(self.schema.numeric) + sum(len(self.categories[c]) for c in self.listed)

    @property
    def width(self) -> int:
        """Columns of the encoded vector."""
        return self.list_width + sum(self.dictionary.sizes[self.rank][c] for c in self.wide)

    def category_count(self, column: str) -> int:
        """Categories of a column, listed or in the dictionary."""
        listed = self.categories.get(column)
        return self.dictionary.sizes[self.rank][column] if listed is None else len(listed)

    def output_names(self) -> list[str]:
        """``numeric__x`` then ``categorical__x_<value>`` names, without
        those of wide columns; ``output_positions`` has all of them."""
        names = [f"numeric__{n}" for n in self.schema.numeric]
        for n in self.listed:
            names += [f"categorical__{n}_{v}" for v in self.categories[n]]
        return names

    def output_positions(self, spark: SparkSession) -> DataFrame:
        """F10 as a table ``(position, name)`` of any length."""
        names = spark.createDataFrame(list(enumerate(self.output_names())), "position bigint, name string")
        if not self.wide:
            return names
        more = feature_positions(spark, self.dictionary, self.wide, self.rank, self.list_width)
        return names.unionByName(more.select("position", "name"))


def imputed_moments(rows: int, observed: int, mean, var_pop, fill: float) -> tuple[float, float]:
    """Mean and population sd after filling the missing rows with ``fill``.

    Chan's parallel combination of the observed values (count, mean,
    variance) with ``rows - observed`` copies of ``fill``: exact, stable,
    and no second pass over the data.
    """
    missing = rows - observed
    if rows == 0:
        return 0.0, 0.0
    if observed == 0:
        return float(fill), 0.0
    mean, m2 = float(mean), float(var_pop) * observed
    delta = float(fill) - mean
    total_mean = mean + delta * missing / rows
    total_m2 = m2 + delta * delta * observed * missing / rows
    return total_mean, (max(total_m2, 0.0) / rows) ** 0.5


def _fit_categories(rows: DataFrame, columns: list[str], marker: str, stats: dict[int, FeatureStats],
                    fold: str | None, list_limit: int) -> None:
    """the categories of every column, for each fold's training side if
    ``fold`` is given.

    Distinct values are counted first.  Beyond a bound the columns with more
    than an equal share of it go into one stored dictionary, from which every
    fold takes its own ranks; only the others are collected, as lists.
    """
    here = F.bit_or(F.expr(f"shiftleft(1L, cast(`{fold}` as int))")) if fold else F.lit(1).cast("long")
    held = [F.col(fold)] if fold else []
    pairs = rows.select(*held, F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), category(c, marker).alias("v")) for c in columns
    ]))).groupBy("c", "v").agg(here.alias("folds")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.bit_count("folds")).alias("pairs")).collect()
        wide: list[str] = []
        if sum(r["pairs"] for r in sizes) > list_limit * max(1, len(stats) if fold else 1):
            wide = [r["c"] for r in sizes if r["n"] * len(columns) > list_limit]
        found = pairs.where(~F.col("c").isin(*wide)).collect()
    finally:
        pairs.unpersist()
    if wide:
        dictionary = build_dictionary(rows, [c for c in columns if c in wide], marker, fold=fold,
                                      fold_count=len(stats) if fold else 0)
        for k, st in stats.items():
            st.dictionary, st.rank = dictionary, f"rank_{k}" if fold else "rank"
    for k, st in stats.items():
        for c in columns:
            if c not in wide:
                st.categories[c] = sorted(r["v"] for r in found if r["c"] == c and (not fold or r["folds"] & ~(1 << k)))


def fit_feature_stats(
    frame: DataFrame,
    schema: FeatureSchema,
    config: PreprocessingConfig | None = None,
    *,
    where: Column | None = None,
    list_limit: int | None = None,
) -> FeatureStats:
    """F3-F9 on the rows selected by ``where`` (the training partition).

    Jobs: one aggregation (counts, means, variances), the medians when
    median imputation is used, one distinct-category job.  The imputed mean / population sd follow algebraically.
    """
    cfg = config or PreprocessingConfig()
    train = frame.filter(where) if where is not None else frame
    fields = {f.name: f.dataType for f in frame.schema.fields}
    stats = FeatureStats(schema, cfg)
    num = list(schema.numeric)
    if num:
        # One pass: rows, non-missing count, mean and population variance of
        # the observed values.
        first = train.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count(as_double(c, fields[c])).alias(f"_c{i}") for i, c in enumerate(num)],
            *[F.avg(as_double(c, fields[c])).alias(f"_a{i}") for i, c in enumerate(num)],
            *[F.var_pop(as_double(c, fields[c])).alias(f"_v{i}") for i, c in enumerate(num)],
        ).first()
        rows = int(first["_rows"])
        stats.training_rows = rows
        if cfg.numeric_imputation is Imputation.MEAN:
            fills = {c: first[f"_a{i}"] for i, c in enumerate(num)}
        else:
            med = column_medians(train, {c: as_double(c, fields[c]) for c in num}, rows)
            fills = {c: med.get(c) for c in num}
        # an all-missing column is kept and filled with 0.
        stats.fill = {c: float(v) if v is not None else 0.0 for c, v in fills.items()}
        if cfg.scale_numeric:
            for i, c in enumerate(num):
                stats.center[c], sd = imputed_moments(
                    rows, int(first[f"_c{i}"]), first[f"_a{i}"], first[f"_v{i}"], stats.fill[c])
                stats.scale[c] = sd if sd > 0 else 1.0  # sd 0 -> divide by 1
    if schema.categorical:
        _fit_categories(train, list(schema.categorical), cfg.categorical_fill_value, {0: stats}, None,
                        LIST_CATEGORIES if list_limit is None else list_limit)
        if not stats.training_rows:
            stats.training_rows = train.count()
    return stats


def transform_sql(stats: FeatureStats) -> str:
    """The SQLTransformer statement holding the learned literals."""
    marker = stats.config.categorical_fill_value.replace("'", "''")
    items = ["*"]
    for c in stats.schema.numeric:
        expr = f"coalesce(CAST(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)) AS DOUBLE), {stats.fill[c]!r}D)"
        if stats.config.scale_numeric:
            expr = f"(({expr}) - {stats.center[c]!r}D) / {stats.scale[c]!r}D"
        items.append(f"{expr} AS `numeric__{c}`")
    for c in stats.schema.categorical:
        items.append(f"coalesce(CAST(`{c}` AS STRING), '{marker}') AS `_cat__{c}`")
    return "SELECT " + ", ".join(items) + " FROM __THIS__"


def preprocessing_stages(stats: FeatureStats) -> list:
    """Fitted, persistable stages that produce the ``features`` vector: all of
    it, or the part before the wide columns."""
    stages: list = [SQLTransformer(statement=transform_sql(stats))]
    onehot_in, onehot_out = [], []
    for c in stats.listed:
        stages.append(StringIndexerModel.from_labels(
            stats.categories[c], inputCol=f"_cat__{c}", outputCol=f"_idx__{c}", handleInvalid="keep"
        ))
        onehot_in.append(f"_idx__{c}")
        onehot_out.append(f"categorical__{c}")
    assembled = [f"numeric__{c}" for c in stats.schema.numeric]
    if onehot_in:
        stages.append(OneHotEncoder(inputCols=onehot_in, outputCols=onehot_out, dropLast=True))
        assembled += onehot_out
    stages.append(VectorAssembler(inputCols=assembled, outputCol=FEATURES_COL, handleInvalid="error"))
    return stages


def fit_preprocessor(train: DataFrame, stats: FeatureStats) -> PipelineModel:
    """Fit the stage list (only the one-hot sizes are read from metadata)."""
    return Pipeline(stages=preprocessing_stages(stats)).fit(train.limit(1))


def validate_preprocessing_inputs(
    frame: DataFrame, schema: FeatureSchema, config: PreprocessingConfig, part_col: str | None = "part"
) -> None:
    """V10 + V11 before any statistics are learned, in one aggregation.

    Infinite numeric values are counted per part (training side reported
    first), reserved-marker hits per categorical column.
    """
    num, cat = list(schema.numeric), list(schema.categorical)
    if not num and not cat:
        return
    fields = {f.name: f.dataType for f in frame.schema.fields}
    marker = config.categorical_fill_value
    split = bool(part_col) and part_col in frame.columns
    grouped = frame.groupBy(part_col) if split else frame.groupBy()
    rows = grouped.agg(
        *[F.count_if(is_infinite(as_double(c, fields[c]))).alias(f"_i{i}") for i, c in enumerate(num)],
        *[F.count_if(F.col(f"`{c}`").cast("string") == F.lit(marker)).alias(f"_m{i}") for i, c in enumerate(cat)],
    ).collect()
    sides = (("train", "Training"), ("validation", "Validation")) if split else ((None, "Final-model training"),)
    for part, label in sides:
        mine = [r for r in rows if part is None or r[part_col] == part]
        names = [c for i, c in enumerate(num) if any(r[f"_i{i}"] for r in mine)]
        if names:
            raise PreprocessingError(
                f"{label} rows hold infinite values in numeric features "
                + ", ".join(repr(n) for n in names) + "; turn them into finite or missing values first.")
    hits = sorted(c for i, c in enumerate(cat) if any(r[f"_m{i}"] for r in rows))
    if hits:
        raise PreprocessingError(
            f"The reserved fill value {marker!r} is a real value in split columns "
            + ", ".join(repr(n) for n in hits) + "; choose another fill value.")


def fold_local_numeric_stats(folded: DataFrame, column: str, fold_count: int) -> DataFrame:
    """train-side statistics of one numeric column for every fold at once:
    ``(fold_number, train_rows, non_missing, mean, median, std_pop)``, the
    imputation and scaling inputs of each fold."""
    narrow = folded.select("fold", f"`{column}`").persist(StorageLevel.MEMORY_AND_DISK)  # read three times
    try:
        per_fold = _fold_moments(narrow, [column])
        medians = _fold_medians(narrow, [column], fold_count)
    finally:
        narrow.unpersist()
    rows = []
    for k in range(1, fold_count + 1):
        seen, mean, var = _merge_moments([(r["_c0"], r["_a0"], r["_v0"]) for j, r in per_fold.items() if j != k])
        rows.append((k, sum(r["_rows"] for j, r in per_fold.items() if j != k), seen, mean,
                     medians.get((k, column)), None if var is None else max(var, 0.0) ** 0.5))
    return folded.sparkSession.createDataFrame(
        rows, "fold_number int, train_rows bigint, non_missing bigint, mean double, median double, std_pop double")


def _fold_moments(folded: DataFrame, columns: list[str]) -> dict:
    """Rows, count, mean and population variance of the columns by fold."""
    fields = {f.name: f.dataType for f in folded.schema.fields}
    return {r["fold"]: r for r in folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(as_double(c, fields[c])).alias(f"_c{i}") for i, c in enumerate(columns)],
        *[F.avg(as_double(c, fields[c])).alias(f"_a{i}") for i, c in enumerate(columns)],
        *[F.var_pop(as_double(c, fields[c])).alias(f"_v{i}") for i, c in enumerate(columns)],
    ).collect()}


def _fold_medians(folded: DataFrame, columns: list[str], fold_count: int) -> dict[tuple[int, str], float]:
    """Median of every column over the rows outside each fold."""
    fields = {f.name: f.dataType for f in folded.schema.fields}
    long = folded.select("fold", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), as_double(c, fields[c]).alias("v")) for c in columns
    ]))).filter(F.col("v").isNotNull())
    return {(k, c): m for (c,), medians in fold_medians(long, ["column_name"], "fold", fold_count).items()
            for k, m in enumerate(medians, 1) if m is not None}


def _merge_moments(states: list[tuple[int, float, float]]) -> tuple[int, float | None, float | None]:
    """Chan's pairwise merge of (count, mean, population variance) states."""
    n, mean, m2 = 0, 0.0, 0.0
    for cnt, mu, var in states:
        if not cnt:
            continue
        total = n + cnt
        delta = float(mu) - mean
        mean += delta * cnt / total
        m2 += float(var) * cnt + delta * delta * n * cnt / total
        n = total
    if n == 0:
        return 0, None, None
    return n, mean, m2 / n


def fit_fold_feature_stats(
    folded: DataFrame, schema: FeatureSchema, config: PreprocessingConfig | None, fold_count: int,
    list_limit: int | None = None,
) -> dict[int, FeatureStats]:
    """F15 for every fold at once, shared by all estimators.

    Per-fold aggregates (count, mean, variance; categories) are computed once
    without copying rows and merged on the driver for "all folds but k"
    (k <= 10 tiny states).  The medians of all training sides come from one
    selection over value counts with a column for each fold.
    """
    cfg = config or PreprocessingConfig()
    num, cat = list(schema.numeric), list(schema.categorical)
    folds = range(1, fold_count + 1)
    out = {k: FeatureStats(schema, cfg) for k in folds}
    per_fold = _fold_moments(folded, num)
    for k in folds:
        out[k].training_rows = sum(int(r["_rows"]) for j, r in per_fold.items() if j != k)
    if num:
        median = cfg.numeric_imputation is Imputation.MEDIAN
        medians = _fold_medians(folded, num, fold_count) if median else {}
        for k in folds:
            st = out[k]
            for i, c in enumerate(num):
                states = [(int(r[f"_c{i}"]), r[f"_a{i}"], r[f"_v{i}"]) for j, r in per_fold.items() if j != k]
                observed, mean, var = _merge_moments(states)
                fill = mean if cfg.numeric_imputation is Imputation.MEAN else medians.get((k, c))
                st.fill[c] = float(fill) if fill is not None else 0.0
                if cfg.scale_numeric:
                    st.center[c], sd = imputed_moments(st.training_rows, observed, mean or 0.0, var or 0.0,
                                                       st.fill[c])
                    st.scale[c] = sd if sd > 0 else 1.0
    if cat:
        _fit_categories(folded, cat, cfg.categorical_fill_value, out, "fold",
                        LIST_CATEGORIES if list_limit is None else list_limit)
    return out


def fold_input_violations(
    folded: DataFrame, schema: FeatureSchema, config: PreprocessingConfig, fold_count: int
) -> dict[int, str | None]:
    """V10 + V11 for every fold from one aggregation grouped by fold.

    Fold k trains on the other folds and validates on itself; the message
    is the one the per-fold check would raise (training side first).
    """
    fields = {f.name: f.dataType for f in folded.schema.fields}
    num, cat = list(schema.numeric), list(schema.categorical)
    marker = config.categorical_fill_value
    if not num and not cat:
        return {k: None for k in range(1, fold_count + 1)}
    rows = folded.groupBy("fold").agg(
        *[F.count_if(is_infinite(as_double(c, fields[c]))).alias(f"_i{i}") for i, c in enumerate(num)],
        *[F.count_if(F.col(f"`{c}`").cast("string") == F.lit(marker)).alias(f"_m{i}") for i, c in enumerate(cat)],
    ).collect()
    out: dict[int, str | None] = {}
    for k in range(1, fold_count + 1):
        train_inf = [c for i, c in enumerate(num) if any(r[f"_i{i}"] for r in rows if r["fold"] != k)]
        val_inf = [c for i, c in enumerate(num) if any(r[f"_i{i}"] for r in rows if r["fold"] == k)]
        markers = sorted(c for i, c in enumerate(cat) if any(r[f"_m{i}"] for r in rows))
        message = None
        for side, names in (("Training", train_inf), ("Validation", val_inf)):
            if names and message is None:
                message = (f"{side} rows hold infinite values in numeric features "
                           + ", ".join(repr(n) for n in names)
                           + "; turn them into finite or missing values first.")
        if message is None and markers:
            message = (f"The reserved fill value {marker!r} is a real value in split columns "
                       + ", ".join(repr(n) for n in markers) + "; choose another fill value.")
        out[k] = message
    return out
