"""Linear models to a certified optimum.

The encoded rows are packed once into blocks (labels plus the non-zero
entries of many rows); every pass sums a few vectors over the blocks: each
task adds up its blocks with NumPy and emits the sums in chunks, Spark adds
the chunks with one group for each, so no reducer sees more than its slice
of the coefficients and the driver only what a model holds.

* Logistic regression: Newton steps.  Up to ``DENSE`` unknowns the curvature
  is summed as a matrix in the same pass as the gradient; beyond, the step
  comes from conjugate gradients, one Hessian-vector product a pass.
* Ridge regression: conjugate gradients on the centred normal equations,
  which are never formed; any width.

The largest gradient component is the certificate of both.

One column of any number of categories needs no weights on the driver: with
the other coefficients given, a category's weights are the optimum of its own
rows alone.  ``grouped_blocks`` keeps the rows of a category in one block;
every pass solves for the weights of its categories there and sums the
gradient and curvature of what remains, a problem in the other coefficients.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unknowns up to which the curvature is summed as a matrix.
DENSE = 512
GRADIENT_LIMIT = 1e-9
_CHUNK = 1 << 12           # numbers of a partial sum in one row
_BLOCK_ENTRIES = 1 << 18   # non-zero entries of a block

_BLOCK = "label array<double>, size array<int>, at array<int>, x array<double>"
_GROUPED = _BLOCK + ", rows array<int>, value array<string>"
_PART = "chunk int, part array<double>"


@dataclass(frozen=True)
class LinearFit:
    """``weights`` (outputs x columns), ``intercept`` (outputs), the mean
    objective, its largest gradient component, and how it was reached."""

    weights: np.ndarray
    intercept: np.ndarray
    objective: float
    gradient: float
    steps: int
    passes: int
    converged: bool


# --- blocks -------------------------------------------------------------------

def _list(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _entries(vec: pa.StructArray, more: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, positions, number for each row) of the non-zero entries of
    vectors (dense or sparse) and of positions of further ones."""
    values, index = vec.field("values"), vec.field("indices")
    size = np.diff(values.offsets.to_numpy())
    x = values.flatten().to_numpy()
    dense = vec.field("type").to_numpy() == 1
    start = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(len(x)) - np.repeat(start[:-1], size)
    at[np.repeat(~dense, size)] = index.flatten().to_numpy()
    keep = x != 0
    row = np.repeat(np.arange(len(size)), size)[keep]
    flags = np.repeat(np.arange(len(size)), np.diff(more.offsets.to_numpy()))
    row = np.concatenate([row, flags])
    x, at = np.concatenate([x[keep], np.ones(len(flags))]), np.concatenate([at[keep], more.flatten().to_numpy()])
    order = np.argsort(row, kind="stable")
    return x[order], at[order], np.bincount(row, minlength=len(size))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to blocks of labels and non-zero entries."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        label = batch.column(1).to_numpy(zero_copy_only=False)
        x, at, size = _entries(batch.column(0), batch.column(2))
        end = np.cumsum(size)
        a = 0
        while a < len(size):
            first = end[a] - size[a]
            b = max(a + 1, int(np.searchsorted(end, first + _BLOCK_ENTRIES, "right")))
            cut = slice(first, end[b - 1])
            yield pa.RecordBatch.from_arrays(
                [_list(label[a:b], pa.float64()), _list(size[a:b], pa.int32()), _list(at[cut], pa.int32()),
                 _list(x[cut], pa.float64())], names=["label", "size", "at", "x"])
            a = b


def row_blocks(rows: DataFrame, features: str, label: Column, ones: str | None = None) -> DataFrame:
    """The rows' vectors and labels in blocks; persist it for the passes.
    ``ones`` names a column with the positions of entries 1 beyond the vector."""
    more = F.col(ones) if ones else F.array().cast("array<bigint>")
    return rows.select(F.col(features), label.cast("double").alias("y"), more.cast("array<bigint>").alias("ones")
                       ).mapInArrow(_pack, _BLOCK)


def _pack_groups(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of their group to blocks of whole groups, at most
    ``most`` of them."""
    def cut(label, x, at, size, value, upto: int) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.append(True, value[1:upto] != value[:upto - 1]))
        bound = np.append(start, upto)
        end = np.append(0, np.cumsum(size))
        a = 0
        while a < len(start):
            full = int(np.searchsorted(end[bound], end[bound[a]] + _BLOCK_ENTRIES, "right")) - 1
            b = min(max(a + 1, full), a + most, len(start))
            i, j = bound[a], bound[b]
            inner = slice(end[i], end[j])
            yield pa.RecordBatch.from_arrays(
                [_list(label[i:j], pa.float64()), _list(size[i:j], pa.int32()), _list(at[inner], pa.int32()),
                 _list(x[inner], pa.float64()), _list(np.diff(bound[a:b + 1]), pa.int32()),
                 _list(value[start[a:b]], pa.string())], names=["label", "size", "at", "x", "rows", "value"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            value = batch.column(3).to_numpy(zero_copy_only=False)
            own = [batch.column(1).to_numpy(zero_copy_only=False), *_entries(batch.column(0), batch.column(2)), value]
            held.append(own)
            if value[0] == value[-1] and held[0][4][0] == value[0]:
                continue  # one group so far
            label, x, at, size, value = (np.concatenate(c) for c in zip(*held))
            last = int(np.flatnonzero(value != value[-1])[-1]) + 1
            yield from cut(label, x, at, size, value, last)
            done = int(size[:last].sum())
            held = [[label[last:], x[done:], at[done:], size[last:], value[last:]]]
        if held:
            whole = [np.concatenate(c) for c in zip(*held)]
            yield from cut(*whole, len(whole[4]))

    return run


def grouped_blocks(rows: DataFrame, features: str, label: Column, group: Column, ones: Column, unknowns: int,
                   outputs: int) -> DataFrame:
    """Blocks that hold all rows of their groups; rows without a group (null)
    stay where they are.  ``ones`` are the positions of further entries 1,
    ``unknowns`` the coefficients besides the groups' own ``outputs`` each."""
    held = rows.select(F.col(features), label.cast("double").alias("y"), ones.cast("array<bigint>").alias("ones"),
                       group.alias("value"))
    most = max(1, (1 << 21) // (outputs * max(outputs, unknowns if unknowns <= DENSE else 1)))
    grouped = (held.where(F.col("value").isNotNull()).repartition("value").sortWithinPartitions("value")
               .mapInArrow(_pack_groups(most), _GROUPED))
    free = held.where(F.col("value").isNull()).drop("value").mapInArrow(_pack, _BLOCK).select(
        "*", F.array().cast("array<int>").alias("rows"), F.array().cast("array<string>").alias("value"))
    return grouped.unionByName(free)


class Block:
    """One block inside a task."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        self.label, size, self.at, self.x = (batch.column(k)[i].values.to_numpy() for k in range(4))
        self.n = len(self.label)
        self.row = np.repeat(np.arange(self.n), size)
        self.rows = batch.column(4)[i].values.to_numpy() if batch.num_columns > 4 else np.zeros(0, np.int32)
        self.grouped = len(self.rows) > 0
        if self.grouped:
            self.value = batch.column(5)[i].values
            self.group = np.repeat(np.arange(len(self.rows)), self.rows)
            self.start = np.cumsum(self.rows) - self.rows

    def by_group(self, r: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``r`` by group."""
        return np.add.reduceat(r, self.start, axis=0)

    def outside(self, r: np.ndarray, alpha: float) -> np.ndarray:
        """What the groups' own ridge coefficients leave of ``r`` (rows)."""
        return r - (self.by_group(r) / (self.rows + alpha))[self.group] if self.grouped else r

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows x outputs: the product with ``w`` (outputs x columns)."""
        return np.stack([np.bincount(self.row, self.x * v[self.at], minlength=self.n) for v in w], axis=1)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        """Outputs x columns: the transposed product with ``r`` (rows x outputs)."""
        return np.stack([np.bincount(self.at, self.x * c[self.row], minlength=width) for c in r.T])

    def matrix(self, width: int) -> np.ndarray:
        out = np.zeros((self.n, width))
        out[self.row, self.at] = self.x
        return out


def summed(blocks: DataFrame, size: int, add: Callable[[Block], np.ndarray]) -> np.ndarray:
    """The sum of ``add(block)`` (``size`` numbers) over all blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                part = add(Block(batch, i))
                total = part if total is None else total + part
        if total is None:
            return
        at = np.arange(0, size, _CHUNK)
        off = np.append(at, size).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // _CHUNK, pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(total))],
            names=["chunk", "part"])

    parts = (blocks.mapInArrow(run, _PART).groupBy("chunk")
             .agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part")))
    out = np.zeros(size)
    for r in parts.collect():
        out[r.chunk * _CHUNK:r.chunk * _CHUNK + len(r.part)] = r.part
    return out


# --- logistic regression --------------------------------------------------------

def _softmax(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class probabilities, log of the normaliser) of rows of scores."""
    top = m.max(axis=1, keepdims=True)
    e = np.exp(m - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (np.log(total) + top)[:, 0]


def _row_state(m: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities, residuals, loss of each row) of scores ``m``; one output
    means two classes with one score, several a score for each class."""
    y = label.astype(np.int64)
    if m.shape[1] == 1:
        s = m[:, 0]
        p = 1.0 / (1.0 + np.exp(-np.clip(s, -700, 700)))
        return p[:, None], (p - y)[:, None], np.logaddexp(0.0, s) - y * s
    p, log_total = _softmax(m)
    at = np.arange(len(y))
    r = p.copy()
    r[at, y] -= 1.0
    return p, r, log_total - m[at, y]


def _curved(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The rows' curvature in their scores times ``u``."""
    return p * (1.0 - p) * u if p.shape[1] == 1 else p * (u - np.sum(p * u, axis=1, keepdims=True))


def _group_curvature(block: Block, p: np.ndarray, c: float) -> np.ndarray:
    """The curvature in the groups' own weights: groups x outputs x outputs."""
    k = p.shape[1]
    eye = np.eye(k)
    return np.stack([block.by_group(p[:, i:i + 1] * (eye[i] - p)) for i in range(k)], axis=1) + eye / c


def _group_weights(block: Block, base: np.ndarray, c: float) -> np.ndarray:
    """Groups x outputs: each group's weights of least loss + |v|^2 / (2 c)
    beside the scores ``base``, by Newton steps that never raise it."""
    def at(v: np.ndarray):
        p, r, loss = _row_state(base + v[block.group], block.label)
        return p, block.by_group(r) + v / c, block.by_group(loss) + np.sum(v * v, axis=1) / (2 * c)

    v = np.zeros((len(block.rows), base.shape[1]))
    p, g, f = at(v)
    for _ in range(100):
        if np.all(np.abs(g).max(axis=1) <= 1e-13 * (1.0 + block.rows)):
            break
        step = np.linalg.solve(_group_curvature(block, p, c), g[:, :, None])[:, :, 0]
        for _ in range(40):
            trial = at(v - step)
            worse = trial[2] > f + 1e-12 * (1.0 + np.abs(f))
            if not worse.any():
                break
            step[worse] /= 2
        low = np.abs(trial[1]).max(axis=1) >= np.abs(g).max(axis=1)
        done = bool(np.all(low & (trial[2] >= f - 1e-12 * (1.0 + np.abs(f)))))
        v = v - step
        p, g, f = trial
        if done:
            break  # rounding
    return v


def _state(block: Block, theta: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(probabilities, residuals, loss) of a block, with the penalty of its
    groups' own weights, which are optimal for ``theta``."""
    m = block.times(theta[:, :-1]) + theta[:, -1]
    own = 0.0
    if block.grouped:
        v = _group_weights(block, m, c)
        m, own = m + v[block.group], float(np.sum(v * v)) / (2 * c)
    p, r, loss = _row_state(m, block.label)
    return p, r, float(np.sum(loss)) + own


def _gradient_pass(theta: np.ndarray, dense: bool, c: float) -> tuple[int, Callable[[Block], np.ndarray]]:
    outputs, width = theta.shape[0], theta.shape[1] - 1
    unknowns = theta.size

    def add(block: Block) -> np.ndarray:
        p, r, loss = _state(block, theta, c)
        g = np.concatenate([block.back(r, width), r.sum(axis=0)[:, None]], axis=1)
        if not dense:  # the diagonal serves as preconditioner
            a = p * (1.0 - p)
            square = np.stack([np.bincount(block.at, block.x ** 2 * k[block.row], minlength=width) for k in a.T])
            return np.concatenate([[loss], g.ravel(), np.concatenate([square, a.sum(axis=0)[:, None]], axis=1).ravel()])
        x = np.concatenate([block.matrix(width), np.ones((block.n, 1))], axis=1)
        h = np.zeros((outputs, width + 1, outputs, width + 1))
        mixed = np.zeros((len(block.rows), outputs, outputs, width + 1))
        for i in range(outputs):
            for j in range(i, outputs):
                a = p[:, i] * ((i == j) - p[:, j])
                h[i, :, j, :] = x.T @ (x * a[:, None])
                h[j, :, i, :] = h[i, :, j, :]
                if block.grouped:
                    mixed[:, i, j] = mixed[:, j, i] = block.by_group(x * a[:, None])
        if block.grouped:  # less what the groups' weights take up
            mixed = mixed.reshape(len(block.rows), outputs, unknowns)
            taken = np.linalg.solve(_group_curvature(block, p, c), mixed)
            h -= (mixed.reshape(-1, unknowns).T @ taken.reshape(-1, unknowns)).reshape(h.shape)
        return np.concatenate([[loss], g.ravel(), h.ravel()])

    return 1 + unknowns + (unknowns ** 2 if dense else unknowns), add


def _curvature_pass(theta: np.ndarray, v: np.ndarray, c: float) -> Callable[[Block], np.ndarray]:
    width = theta.shape[1] - 1

    def add(block: Block) -> np.ndarray:
        p, _, _ = _state(block, theta, c)
        u = _curved(p, block.times(v[:, :-1]) + v[:, -1])
        if block.grouped:
            taken = np.linalg.solve(_group_curvature(block, p, c), block.by_group(u)[:, :, None])[:, :, 0]
            u = u - _curved(p, taken[block.group])
        return np.concatenate([block.back(u, width), u.sum(axis=0)[:, None]], axis=1).ravel()

    return add


def _conjugate(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray, limit: float,
               most: int) -> tuple[np.ndarray, int, float]:
    """(solution, products, largest residual) of a positive system."""
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    p, rz, n = z.copy(), float(r @ z), 0
    while np.abs(r).max(initial=0.0) > limit and n < most:
        q = apply(p)
        n += 1
        step = rz / float(p @ q)
        x += step * p
        r -= step * q
        z = r / diagonal
        rz, old = float(r @ z), rz
        p = z + (rz / old) * p
    return x, n, float(np.abs(r).max(initial=0.0))


def fit_logistic(blocks: DataFrame, rows: int, classes: int, width: int, c: float, *, dense: int = DENSE,
                 limit: float = GRADIENT_LIMIT, most_steps: int = 200) -> LinearFit:
    """Minimises mean(loss) + |w|^2 / (2 c rows); intercepts are free.

    Two classes have one weight vector, more have one each, whose free
    intercepts sum to zero.  A step that raises the objective is halved.
    """
    outputs = 1 if classes == 2 else classes
    penalty = 1.0 / (c * rows)
    theta = np.zeros((outputs, width + 1))
    matrix = theta.size <= dense
    keep, passes, low, best = None, 0, np.inf, (np.inf, theta, np.inf)
    for step in range(1, most_steps + 1):
        size, add = _gradient_pass(theta, matrix, c)
        total = summed(blocks, size, add)
        passes += 1
        value = total[0] / rows + penalty / 2 * float(np.sum(theta[:, :-1] ** 2))
        g = total[1:1 + theta.size].reshape(theta.shape) / rows
        g[:, :-1] += penalty * theta[:, :-1]
        largest = float(np.abs(g).max())
        if keep is not None and value > low + 1e-13 * abs(low) and largest > best[0]:
            theta = (theta + keep) / 2  # too far
            if np.abs(theta - keep).max() < 1e-15:
                break
            continue
        stalled = keep is not None and largest >= best[0] and value >= low
        if largest < best[0]:
            best = (largest, theta, value)
        low, keep = min(low, value), theta
        if largest <= limit or stalled:
            break
        curve = total[1 + theta.size:] / rows
        if matrix:
            h = curve.reshape(theta.size, theta.size)
            cut = np.arange(theta.size).reshape(theta.shape)
            h[cut[:, :-1], cut[:, :-1]] += penalty
            if outputs > 1:  # equal shifts of all intercepts change nothing: fix them
                h[np.ix_(cut[:, -1], cut[:, -1])] += 1.0 / outputs
            move = np.linalg.lstsq(h, g.ravel(), rcond=None)[0]
        else:
            diagonal = curve.reshape(theta.shape) + 1e-12
            diagonal[:, :-1] += penalty

            def product(v: np.ndarray, theta: np.ndarray = theta) -> np.ndarray:
                v = v.reshape(theta.shape)
                out = summed(blocks, theta.size, _curvature_pass(theta, v, c)).reshape(theta.shape) / rows
                out[:, :-1] += penalty * v[:, :-1]
                if outputs > 1:
                    out[:, -1] += v[:, -1].mean()
                return out.ravel()

            move, used, _ = _conjugate(product, g.ravel(), diagonal.ravel(),
                                       max(min(0.1, largest ** 0.5) * largest, limit / 10), 10 * theta.size)
            passes += used
        theta = theta - move.reshape(theta.shape)
    largest, theta, value = best
    intercept = theta[:, -1] - (theta[:, -1].mean() if outputs > 1 else 0.0)
    return LinearFit(theta[:, :-1], intercept, value, largest, step, passes, largest <= limit)


# --- ridge regression ------------------------------------------------------------

def fit_ridge(blocks: DataFrame, rows: int, width: int, alpha: float, *, limit: float = 1e-10,
              most_products: int = 10_000) -> LinearFit:
    """Minimises |y - Xw - b|^2 + alpha |w|^2 with a free intercept b.

    The gradient (with respect to w, b being optimal for w) is reported as a
    share of its size at w = 0, which ``limit`` bounds.
    """
    def moments(block: Block) -> np.ndarray:
        y, one = block.outside(block.label, alpha), block.outside(np.ones(block.n), alpha)
        return np.concatenate([
            [y.sum(), block.label @ y, one.sum()], np.bincount(block.at, block.x * one[block.row], minlength=width),
            np.bincount(block.at, block.x ** 2, minlength=width),
            np.bincount(block.at, block.x * y[block.row], minlength=width)])

    total = summed(blocks, 3 + 3 * width, moments)
    weight = total[2]  # the number of rows, less what groups of their own take up
    y_mean = total[0] / weight
    x_sum, x_square, xy = (total[3 + k * width:3 + (k + 1) * width] for k in range(3))
    b = xy - x_sum * y_mean
    diagonal = np.maximum(x_square - x_sum ** 2 / weight, 0.0) + alpha + 1e-300

    def product(v: np.ndarray) -> np.ndarray:
        def add(block: Block) -> np.ndarray:
            u = block.outside(block.times(v[None, :])[:, 0], alpha)
            return np.append(block.back(u[:, None], width)[0], u.sum())
        out = summed(blocks, width + 1, add)
        return out[:-1] - x_sum * (out[-1] / weight) + alpha * v

    scale = float(np.abs(b).max(initial=0.0))
    w, r, left, n, passes = np.zeros(width), b, scale, 0, 1
    while left > limit * scale and n < most_products:
        move, used, _ = _conjugate(product, r, diagonal, limit * scale / 2, most_products - n)
        w, n, passes = w + move, n + used, passes + used + 1
        r = b - product(w)  # the recurrence loses digits: go on from the true residual
        before, left = left, float(np.abs(r).max())
        if left > before / 2:
            break
    intercept = y_mean - float(x_sum @ w) / weight
    loss = total[1] - weight * y_mean ** 2 - float(b @ w)  # of the optimum, up to rounding
    share = left / scale if scale else 0.0
    return LinearFit(w[None, :], np.array([intercept]), loss / rows, share, n, passes, share <= limit)


# --- weights of groups -----------------------------------------------------------

def group_weights(blocks: DataFrame, fit: LinearFit, *, c: float | None = None, alpha: float = 0.0) -> DataFrame:
    """(value, n, weights) of the groups of ``grouped_blocks`` beside a fit:
    those of a logistic regression with ``c``, else of a ridge regression."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                if not block.grouped:
                    continue
                m = block.times(fit.weights) + fit.intercept
                if c is None:
                    v = (block.by_group(block.label - m[:, 0]) / (block.rows + alpha))[:, None]
                else:
                    v = _group_weights(block, m, c)
                off = pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [block.value, pa.array(block.rows, pa.int64()), pa.ListArray.from_arrays(off, pa.array(v.ravel()))],
                    names=["value", "n", "weights"])

    return blocks.mapInArrow(run, "value string, n bigint, weights array<double>")
