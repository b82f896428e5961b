"""Category dictionaries of any size.

A dictionary is a table ``(column_name, value, n, rank...)``: the distinct
values of every column, numbered from 0 in their order.  The numbers come
from range partitions: values are range-partitioned and sorted, written to
the shared folder (which fixes the partitions), counted per partition, and a
value's rank is its place in its partition plus the counts of earlier ones.
Nothing but the per-partition counts passes through one task.

Rows meet the dictionary in a join.  Values that make up more than one in
``HOT_SHARE`` of all rows, at most that many of a column, are looked up in a
broadcast table; the rows that hold them are spread over the join's
partitions, so no task gets a frequent value's rows together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWriter, MLReader, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

HOT_SHARE = 1000
_SPREAD = 1 << 20


@dataclass(frozen=True)
class Dictionary:
    """Where a dictionary is stored, and the number of values of each column
    for each rank: ``sizes[rank][column]``."""

    path: str
    sizes: dict[str, dict[str, int]]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def category(name: str, marker: str) -> Column:
    """A column's category: its text, a missing value being ``marker``."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(marker))


def build_dictionary(rows: DataFrame, columns: list[str], marker: str, *, fold: str | None = None,
                     fold_count: int = 0) -> Dictionary:
    """The dictionary of ``columns``.

    ``rank`` numbers all values.  With a ``fold`` column ``rank_1`` to
    ``rank_k`` also number the values that occur outside that fold (null for
    others): the categories of each fold's training side, from one pass.
    """
    spark = rows.sparkSession
    root = f"{checkpoint_dir(spark)}/tessera-dictionary/{uuid.uuid4().hex}"
    here = F.bit_or(F.expr(f"shiftleft(1L, cast(`{fold}` as int))")) if fold else F.lit(0).cast("long")
    held = [F.col(fold)] if fold else []
    pairs = (rows.select(*held, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), category(c, marker).alias("value")) for c in columns])))
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), here.alias("folds")))
    (pairs.repartitionByRange("column_name", "value").sortWithinPartitions("column_name", "value")
     .withColumn("part", F.spark_partition_id()).write.parquet(f"{root}/values"))
    values = spark.read.parquet(f"{root}/values")
    present = {"rank": F.lit(True)}
    for k in range(1, fold_count + 1 if fold else 0):
        present[f"rank_{k}"] = F.col("folds").bitwiseAND(F.lit(~(1 << k))) != 0
    flags = [p.cast("long").alias(f"has_{r}") for r, p in present.items()]
    marked = values.select("column_name", "value", "n", "part", *flags)
    counts = marked.groupBy("column_name", "part").agg(*[F.sum(f"has_{r}").alias(f"sum_{r}") for r in present])
    earlier = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("column_name", "part", *[
        F.coalesce(F.sum(f"sum_{r}").over(earlier), F.lit(0)).alias(f"off_{r}") for r in present])
    within = Window.partitionBy("column_name", "part").orderBy("value")
    ranks = [F.when(F.col(f"has_{r}") == 1, F.col(f"off_{r}") + F.sum(f"has_{r}").over(within) - 1).alias(r)
             for r in present]
    # One row for each column and range partition: a bounded broadcast.
    (marked.join(F.broadcast(offsets), ["column_name", "part"]).select("column_name", "value", "n", *ranks)
     .write.parquet(f"{root}/ranks"))
    sizes: dict[str, dict[str, int]] = {r: dict.fromkeys(columns, 0) for r in present}
    for row in counts.groupBy("column_name").agg(*[F.sum(f"sum_{r}").alias(r) for r in present]).collect():
        for r in present:
            sizes[r][row["column_name"]] = int(row[r])
    return Dictionary(f"{root}/ranks", sizes)


def look_up(df: DataFrame, entries: DataFrame, value: str, found: str, out: str) -> DataFrame:
    """Adds ``out``: the ``found`` column of the row of ``entries`` (value, n,
    ``found``) with this row's ``value``, null where there is none."""
    total = entries.agg(F.sum("n")).scalar()
    top = (entries.where(F.col("n") * HOT_SHARE > total)
           .select(F.col("value").alias("_hot_value"), F.struct(F.col(found).alias("v")).alias("_hot")))
    others = entries.where(F.col("n") * HOT_SHARE <= total).select(
        F.col("value").alias("_value"), F.lit(0).alias("_spot"), F.struct(F.col(found).alias("v")).alias("_rare"))
    # A hot row needs no partner: its spot (never 0) only spreads it.
    spot = F.when(F.col("_hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD)) + 1)
    held = F.col(f"`{value}`")
    return (df.join(F.broadcast(top), held == F.col("_hot_value"), "left")
            .withColumn("_own", F.coalesce(spot, F.lit(0)).cast("int"))
            .join(others, (held == F.col("_value")) & (F.col("_own") == F.col("_spot")), "left")
            .withColumn(out, F.coalesce("_hot", "_rare")["v"])
            .drop("_hot_value", "_hot", "_own", "_value", "_spot", "_rare"))


def category_positions(df: DataFrame, dictionary: Dictionary, columns: list[str], rank: str, first: int,
                       out: str = "_wide") -> DataFrame:
    """Adds ``out``: the positions of the row's categories in the encoded
    vector, which begins with ``first`` other entries.  The category of
    column c is read from ``_cat__c``; values without a rank have no position."""
    table = dictionary.table(df.sparkSession)
    at, names = first, []
    for i, c in enumerate(columns):
        entries = table.where(F.col("column_name") == c).select("value", "n", (F.col(rank) + at).alias("position"))
        names.append(f"_at_{i}")
        df = look_up(df, entries, f"_cat__{c}", "position", names[-1])
        at += dictionary.sizes[rank][c]
    return df.withColumn(out, F.array_compact(F.array(*names))).drop(*names)


def feature_positions(spark: SparkSession, dictionary: Dictionary, columns: list[str], rank: str, first: int
                      ) -> DataFrame:
    """F10 as a table: ``(position, name, column_name, value, n)`` of the
    encoded categories."""
    at, start = first, F.lit(None).cast("long")
    for c in columns:
        start = F.when(F.col("column_name") == c, F.lit(at)).otherwise(start)
        at += dictionary.sizes[rank][c]
    return (dictionary.table(spark).where(F.col("column_name").isin(*columns) & F.col(rank).isNotNull())
            .select((start + F.col(rank)).alias("position"),
                    F.concat(F.lit("categorical__"), "column_name", F.lit("_"), "value").alias("name"),
                    "column_name", "value", "n"))


# --- scoring ----------------------------------------------------------------------

def write_weights(positions: DataFrame, weights: np.ndarray, first: int, path: str) -> None:
    """Stores (column_name, value, n, weights): row ``position - first`` of
    ``weights`` for every row of ``positions``, looked up inside the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = weights[batch.column(0).to_numpy() - first]
            off = pa.array(np.arange(0, mine.size + 1, weights.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.ListArray.from_arrays(off, pa.array(mine.ravel()))],
                names=["column_name", "value", "n", "weights"])

    (positions.select("position", "column_name", "value", "n")
     .mapInArrow(run, "column_name string, value string, n bigint, weights array<double>").write.parquet(path))


class CategoryWeights(Transformer, MLWritable, DefaultParamsReadable):
    """Adds the weights of a row's categories to the scores of the other
    features.  ``baseCol`` holds these scores (a vector, or a number for a
    regression); the weights are a stored table (column_name, value, n,
    weights) that is copied along when the model is saved.  ``outputCol`` is the
    sum, or for several scores the number of the largest, the first of equals."""

    baseCol = Param(Params._dummy(), "baseCol", "scores of the other features", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "prediction", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "categorical columns", TypeConverters.toListString)
    table = Param(Params._dummy(), "table", "path of the weights", TypeConverters.toString)
    scores = Param(Params._dummy(), "scores", "scores of a row", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, baseCol=None, outputCol=None, columns=None, table=None, scores=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        several = get(self.scores) > 1
        base = F.col(get(self.baseCol))
        total = vector_to_array(base) if several else F.array(base)
        weights = df.sparkSession.read.parquet(get(self.table))
        df, names = df.withColumn("_total", total), []
        for i, c in enumerate(get(self.columns)):
            names.append(f"_w_{i}")
            entries = weights.where(F.col("column_name") == c).select("value", "n", "weights")
            df = look_up(df, entries, f"_cat__{c}", "weights", names[-1])
            added = F.zip_with("_total", names[-1], lambda a, b: a + b)
            df = df.withColumn("_total", F.when(F.col(names[-1]).isNull(), F.col("_total")).otherwise(added))
        out = (F.array_position("_total", F.array_max("_total")) - 1).cast("double") if several else F.col("_total")[0]
        return df.withColumn(get(self.outputCol), out).drop("_total", *names)

    def write(self):
        return _WeightsWriter(self)

    @classmethod
    def read(cls):
        return _WeightsReader(cls)


class _WeightsWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        spark = SparkSession.getActiveSession()
        spark.read.parquet(self.instance.getOrDefault(self.instance.table)).write.parquet(f"{path}/weights")


class _WeightsReader(DefaultParamsReader, MLReader):
    def load(self, path: str) -> CategoryWeights:
        model = super().load(path)
        return model._set(table=f"{path}/weights")
