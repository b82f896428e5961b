"""Random-forest classifiers fitted on counted rows.

A tree's split statistics are sums over rows of (bins of the features, label)
weighted by how often the tree's bootstrap sample holds the row.  Rows with
equal bins and label are therefore one row whose counts are added: every sum
is a sum of integers and stays exact, so the forest is the one that
``RandomForestClassifier.fit`` grows, tree by tree, whatever the number of
rows behind a counted row.  Spark keeps 4 bytes a row and tree and visits
every row for every tree and level; here each row is drawn for its trees once.

The steps are those of Spark's ``RandomForest.run`` and call its own parts
(metadata, split candidates, growing); between them the rows are binned,
drawn and counted in SQL.  A partition's draws come from the generator Spark
gives it: Poisson(1), seeded by seed + partition + 1, one draw a tree for each
row in order.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jvm import Jvm
from .quantile import count_below

#: Rows are counted where one counted row stands for so many at least.
ROWS_PER_COUNTED_ROW = 4
#: Trees whose counts are added in one aggregation; features binned in SQL.
MAX_COUNTED_TREES = 400
MAX_BINNED_FEATURES = 200
#: A counted row's draws are 32-bit numbers.
MAX_COUNTED_ROWS = 1_000_000_000


def bootstrap_counts(df: DataFrame, trees: int, seed: int, partitions: int) -> Column:
    """How often each tree's bootstrap sample holds the row, as an array.

    A task reads its own copy of its partition's generator and draws on.
    """
    j = Jvm(df.sparkSession.sparkContext)
    generators = j.jvm.java.util.ArrayList()
    for p in range(partitions):
        drawn = j.jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0)
        drawn.reseedRandomGenerator(seed + p + 1)
        generators.add(drawn)
    held = j.module("org.apache.spark.sql.catalyst.expressions.Literal").fromObject(generators)
    mine = j.invoke(held, "get", j.object_kind("org.apache.commons.math3.distribution.PoissonDistribution"),
                    j.expression(F.spark_partition_id()))
    counts = j.invoke(mine, "sample", j.object_kind("[I"), j.literal(trees), pure=False)
    return j.column(j.static(
        "org.apache.spark.sql.catalyst.expressions.UnsafeArrayData", "fromPrimitiveArray",
        j.jvm.org.apache.spark.sql.types.ArrayType(j.kind("int"), False), counts, pure=False))


def _bins(values: Column, splits, arities, width: int) -> list[Column]:
    """The bin of every feature: split candidates below a continuous value,
    the value itself of a categorical one."""
    found = []
    for f in range(width):
        value = values[f]
        if arities.contains(f):
            found.append(value.cast("int"))
        else:
            bounds = F.array(*[F.lit(s.threshold()) for s in splits[f]]).cast("array<double>")
            found.append(count_below(bounds, value, 0, len(splits[f])).cast("int"))
    return found


def _bagged(counted: DataFrame):
    """Rows (label, bins, counts) as Spark's bagged tree points."""
    j = Jvm(counted.sparkSession.sparkContext)
    ints, package = j.object_kind("[I"), "org.apache.spark.ml.tree.impl"
    types = [f.dataType() for f in counted._jdf.schema().fields()]
    at = lambda i: j.jvm.org.apache.spark.sql.catalyst.analysis.GetColumnByOrdinal(i, types[i])
    one = j.literal(1.0)
    point = j.instance(f"{package}.TreePoint", [at(0), j.invoke(at(1), "toIntArray", ints), one])
    bagged = j.instance(f"{package}.BaggedPoint", [point, j.invoke(at(2), "toIntArray", ints), one])
    plain = j.jvm.org.apache.spark.sql.Encoders.javaSerialization(j.cls(f"{package}.BaggedPoint"))
    held = j.module("org.apache.spark.sql.catalyst.encoders.ExpressionEncoder").apply(plain)
    encoder = j.jvm.org.apache.spark.sql.catalyst.encoders.ExpressionEncoder(plain, held.objSerializer(), bagged)
    plan = counted._jdf.queryExecution().analyzed()
    return j.jvm.org.apache.spark.sql.classic.Dataset(counted.sparkSession._jsparkSession, plan, encoder).rdd().persist(
        j.jvm.org.apache.spark.storage.StorageLevel.MEMORY_AND_DISK())


def fit_classifier(est: RandomForestClassifier, rows: DataFrame, classes: int) -> RandomForestClassificationModel:
    """``est.fit(rows)`` for persisted rows (features, label) in a fixed
    layout, on counted rows where these are much fewer."""
    trees, features, label = est.getNumTrees(), est.getFeaturesCol(), est.getLabelCol()
    drawn_alike = est.getBootstrap() and est.getSubsamplingRate() == 1.0  # Poisson(1) for each row
    if not drawn_alike or min(trees, classes) < 2 or trees > MAX_COUNTED_TREES:
        return est.fit(rows)
    j = Jvm(rows.sparkSession.sparkContext)
    est._transfer_params_to_java()
    java, ml = est._java_obj, j.jvm.org.apache.spark.ml
    arities = j.module("org.apache.spark.ml.util.MetadataUtils").getCategoricalFeatures(
        rows._jdf.schema().apply(features))
    algo = j.module("org.apache.spark.mllib.tree.configuration.Algo").Classification()
    strategy = java.getOldStrategy(arities, classes, algo, java.getOldImpurity())
    strategy.setBootstrap(True)
    instances = j.module("org.apache.spark.ml.util.DatasetUtils").extractInstances(java, rows._jdf, j.some(classes))
    subset, seed = est.getFeatureSubsetStrategy(), est.getSeed()
    metadata = j.module("org.apache.spark.ml.tree.impl.DecisionTreeMetadata").buildMetadata(
        instances, strategy, trees, subset)
    width = metadata.numFeatures()
    if width > MAX_BINNED_FEATURES or metadata.numExamples() > MAX_COUNTED_ROWS:
        return est.fit(rows)
    grower = j.module("org.apache.spark.ml.tree.impl.RandomForest")
    splits = grower.findSplits(instances, metadata, seed)
    values = rows.select(F.col(label).cast("double").alias("_label"), vector_to_array(features).alias("_values"))
    binned = values.select("_label", F.array(*_bins(F.col("_values"), splits, arities, width)).alias("_bins"))
    cells = binned.agg(F.approx_count_distinct(F.xxhash64("_label", "_bins"))).first()[0]
    if cells * ROWS_PER_COUNTED_ROW > metadata.numExamples():
        return est.fit(rows)
    draws = bootstrap_counts(rows, trees, seed, instances.getNumPartitions())
    drawn = binned.select("_label", "_bins", draws.alias("_counts"))
    counted = drawn.groupBy("_label", "_bins").agg(*[F.sum(F.col("_counts")[t]).cast("int").alias(f"_t{t}")
                                                    for t in range(trees)])
    counted = counted.select("_label", "_bins", F.array(*[f"_t{t}" for t in range(trees)]).alias("_counts"))
    bagged, none = _bagged(counted), j.none()
    try:
        grown = grower.runBagged(bagged, metadata, j.sc._jsc.broadcast(splits), strategy, trees, subset, seed,
                                 none, True, none, 0)
    finally:
        bagged.unpersist(False)
    held = j.sc._gateway.new_array(ml.classification.DecisionTreeClassificationModel, trees)
    for t in range(trees):
        held[t] = grown[t]
    model = RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(
        java.uid(), held, width, classes))
    return est._copyValues(model)
