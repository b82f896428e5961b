"""Linear fits against closed forms and against NumPy on the same rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import linear


def blocks_of(spark, x, y, parts=3, sparse=False):
    if sparse:
        vec = [Vectors.sparse(x.shape[1], np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in x]
    else:
        vec = [Vectors.dense(r) for r in x]
    df = spark.createDataFrame([(v, float(t)) for v, t in zip(vec, y)], ["features", "y"]).repartition(parts)
    return linear.row_blocks(df, "features", F.col("y")).persist()


def logistic_gradient(fit, x, y, classes, c):
    """Largest component of the objective's gradient, by NumPy."""
    m = x @ fit.weights.T + fit.intercept
    if classes == 2:
        r = (1 / (1 + np.exp(-m[:, 0])) - y)[:, None]
    else:
        e = np.exp(m - m.max(axis=1, keepdims=True))
        r = e / e.sum(axis=1, keepdims=True) - np.eye(classes)[y]
    g = r.T @ x / len(y) + fit.weights / (c * len(y))
    return max(np.abs(g).max(), np.abs(r.mean(axis=0)).max())


@pytest.mark.parametrize("classes", [2, 4])
def test_logistic_reaches_the_optimum_both_ways(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(600, 7)) * [1, 1, 5, 0.1, 1, 1, 1]
    x[rng.random(x.shape) < 0.4] = 0.0
    y = np.argmax(x @ rng.normal(size=(7, classes)) + rng.gumbel(size=(600, classes)), axis=1)
    data = blocks_of(spark, x, y, sparse=True)
    by_matrix = linear.fit_logistic(data, 600, classes, 7, 1.0)
    by_products = linear.fit_logistic(data, 600, classes, 7, 1.0, dense=0)
    for fit in (by_matrix, by_products):
        assert fit.converged and fit.gradient <= 1e-9
        assert logistic_gradient(fit, x, y, classes, 1.0) < 1e-8
    assert np.allclose(by_matrix.weights, by_products.weights, atol=1e-6)
    assert np.allclose(by_matrix.intercept, by_products.intercept, atol=1e-6)
    if classes > 2:
        assert abs(by_matrix.intercept.sum()) < 1e-9


def test_logistic_on_separable_rows_and_on_large_columns(spark):
    x = np.concatenate([np.full((50, 1), -1.0), np.full((50, 1), 1.0)])
    y = (x[:, 0] > 0).astype(int)
    fit = linear.fit_logistic(blocks_of(spark, x, y), 100, 2, 1, 1.0)
    assert fit.converged and logistic_gradient(fit, x, y, 2, 1.0) < 1e-8
    far = 1e4 + 1e3 * np.random.default_rng(1).normal(size=(200, 2))  # neither centred nor scaled
    y = (far[:, 0] - far[:, 1] + 500 * np.random.default_rng(2).normal(size=200) > 0).astype(int)
    fit = linear.fit_logistic(blocks_of(spark, far, y), 200, 2, 2, 1.0, limit=1e-6)
    assert fit.converged


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 400)) + 3.0
    x[rng.random(x.shape) < 0.7] = 0.0
    y = x @ rng.normal(size=400) + rng.normal(size=700) + 40
    fit = linear.fit_ridge(blocks_of(spark, x, y, sparse=True), 700, 400, 1.0)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(400), xc.T @ yc)
    assert fit.converged and np.allclose(fit.weights[0], want, atol=1e-7)
    assert np.isclose(fit.intercept[0], y.mean() - x.mean(axis=0) @ want)
    resid = yc - xc @ want
    assert np.isclose(fit.objective, (resid @ resid + want @ want) / 700)


def test_ridge_of_fifty_thousand_columns(spark):
    """One indicator a row and column: the closed form is diagonal but for the mean."""
    width = 50_000
    rows = spark.range(2 * width).select(
        F.expr(f"cast(id % {width} as int)").alias("c"), F.expr("pmod(hash(id), 1000) / 100").alias("y"))
    vec = rows.rdd.map(lambda r: (Vectors.sparse(width, [r.c], [1.0]), float(r.y))).toDF(["features", "y"])
    data = linear.row_blocks(vec, "features", F.col("y")).persist()
    fit = linear.fit_ridge(data, 2 * width, width, 1.0)
    by = np.zeros(width)
    for r in rows.groupBy("c").agg(F.sum("y").alias("s")).collect():
        by[r.c] = r.s
    w = (by - 2 * fit.intercept[0]) / 3  # (2 + 1) w = sum of y - 2 b
    assert fit.converged and np.allclose(fit.weights[0], w, atol=1e-8)


def test_empty_blocks_and_constant_target(spark):
    x, y = np.ones((5, 2)), np.full(5, 2.5)
    fit = linear.fit_ridge(blocks_of(spark, x, y), 5, 2, 1.0)
    assert fit.converged and np.allclose(fit.weights, 0) and np.isclose(fit.intercept[0], 2.5)


_GROUP_ROWS = T.StructType([T.StructField("features", VectorUDT()), T.StructField("y", T.DoubleType()),
                            T.StructField("city", T.StringType()), T.StructField("ones", T.ArrayType(T.LongType()))])


def grouped_of(spark, x, y, city, outputs, free=()):
    """``x`` and the categories as groups; those in ``free`` as columns after ``x``."""
    rows = [(Vectors.dense(r), float(t), None if c in free else c, [x.shape[1] + free.index(c)] if c in free else [])
            for r, t, c in zip(x, y, city)]
    df = spark.createDataFrame(rows, _GROUP_ROWS).repartition(3)
    unknowns = outputs * (x.shape[1] + len(free) + 1)
    return linear.grouped_blocks(df, "features", F.col("y"), F.col("city"), F.col("ones"), unknowns, outputs).persist()


@pytest.mark.parametrize("classes", [2, 3])
def test_weights_of_groups_equal_those_of_indicator_columns(spark, classes):
    rng = np.random.default_rng(classes)
    city = np.array([f"c{k}" for k in rng.integers(0, 40, size=300)])
    x = rng.normal(size=(300, 2))
    names = sorted(set(city))
    flags = (city[:, None] == np.array(names)).astype(float)
    free = ("c3",)
    y = np.argmax(np.stack([x[:, 0] * k + rng.gumbel(size=300) for k in range(classes)], axis=1), axis=1)
    outputs = 1 if classes == 2 else classes
    want = linear.fit_logistic(blocks_of(spark, np.hstack([x, flags]), y), 300, classes, 42, 1.0)
    blocks = grouped_of(spark, x, y, city, outputs, free)
    for dense in (linear.DENSE, 0):
        fit = linear.fit_logistic(blocks, 300, classes, 3, 1.0, dense=dense)
        assert fit.converged and fit.weights.shape == (outputs, 3)
        assert np.allclose(fit.weights[:, :2], want.weights[:, :2], atol=1e-6)
        assert np.allclose(fit.weights[:, 2], want.weights[:, 2 + names.index("c3")], atol=1e-6)
    own = {r["value"]: r for r in linear.group_weights(blocks, fit, c=1.0).collect()}
    assert sorted(own) == [n for n in names if n not in free]
    for i, name in enumerate(names):
        if name not in free:
            assert np.allclose(own[name]["weights"], want.weights[:, 2 + i], atol=1e-6)
            assert own[name]["n"] == np.sum(city == name)
    t = x[:, 0] + 2.0 * (city == "c5") + rng.normal(size=300)
    want = linear.fit_ridge(blocks_of(spark, np.hstack([x, flags]), t), 300, 42, 1.0)
    blocks = grouped_of(spark, x, t, city, 1, free)
    fit = linear.fit_ridge(blocks, 300, 3, 1.0)
    assert fit.converged and np.allclose(fit.weights[0, :2], want.weights[0, :2], atol=1e-7)
    assert np.isclose(fit.intercept[0], want.intercept[0]) and np.isclose(fit.objective, want.objective)
    own = {r["value"]: r["weights"][0] for r in linear.group_weights(blocks, fit, alpha=1.0).collect()}
    assert np.allclose([own[n] for n in names if n != "c3"], np.delete(want.weights[0, 2:], names.index("c3")), atol=1e-7)


def test_no_group_is_cut_between_blocks():
    """Groups that span batches, larger and smaller than a block."""
    import pyarrow as pa

    value = ["a"] * 5 + ["b"] + ["c"] * 25 + ["d", "e"]
    vec = pa.StructArray.from_arrays(
        [pa.array([1] * 33, pa.int8()), pa.array([[] for _ in value], pa.list_(pa.int32())),
         pa.array([[float(i + 1)] for i in range(33)])], names=["type", "indices", "values"])
    batch = pa.RecordBatch.from_arrays(
        [vec, pa.array(np.arange(33.0)), pa.array([[] for _ in value], pa.list_(pa.int64())), pa.array(value)],
        names=["features", "y", "ones", "value"])
    out = [b for b in linear._pack_groups(2)(batch.slice(i, 4) for i in range(0, 33, 4))]
    found = [(v, n) for b in out for v, n in zip(b.column(5)[0].as_py(), b.column(4)[0].as_py())]
    assert found == [("a", 5), ("b", 1), ("c", 25), ("d", 1), ("e", 1)]
    assert all(len(b.column(5)[0]) <= 2 for b in out)
    assert [x for b in out for x in b.column(3)[0].as_py()] == [i + 1.0 for i in range(33)]
