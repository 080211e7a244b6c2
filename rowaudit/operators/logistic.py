"""Logistic regressions of all cross-validation folds, fitted together over sparse rows.

A row is (row_id, fold, label_idx, cols, vals): the positions and values of its non-zero
features.  Model ``f`` is fitted on the rows outside fold ``f``.  Every pass over the rows
adds up the losses and gradients of all models at once, so the number of Spark jobs does
not depend on the number of folds; a row costs its non-zero entries, whatever the width.

Centering and scaling never densify a row: with column scale s and mean m the margin is
``sum(val * s * w) - sum(m * s * w)``, and the gradient ``s * (sum(r * val) - m * sum(r))``.

Rows are packed into blocks of ``BLOCK`` once (``pack``), with their entries in both orders and their
lengths, so a pass is a few array operations per block for all models together: matrix products
where there are few columns (``DENSE``), sums over runs of entries otherwise.

The objective of each model is ``sum(weight * loss) + |w|^2 / 2`` (intercepts free), with the
sigmoid for two classes and the softmax for more.  The driver holds the coefficients
(models x classes x columns) and runs L-BFGS on each model with a common pass per trial.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.session import kept

MAX_PASSES, TOLERANCE, MEMORY = 400, 1e-6, 10
#: Rows of a block, and the greatest number of columns that are laid out as a matrix.
BLOCK, DENSE = 2_000, 64


@dataclass(frozen=True)
class Space:
    """What the models see of the columns: ``scale`` and ``mean`` per model (models x columns),
    ``unit`` to divide each row by its length after scaling, and class ``weight`` (models x classes)."""
    scale: np.ndarray
    mean: np.ndarray
    weight: np.ndarray
    unit: bool = False

    @property
    def models(self) -> int:
        return len(self.scale)

    @property
    def vectors(self) -> int:
        return 1 if self.weight.shape[1] == 2 else self.weight.shape[1]


def _values(space: Space, m: int, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
    v = val * space.scale[m][col]
    if space.unit:
        size = np.sqrt(np.bincount(row, v * v, n))
        v = v / np.where(size > 0, size, 1.0)[row]
    return v


def _margins(space: Space, m: int, theta: np.ndarray, row, col, v, n: int) -> np.ndarray:
    """(vectors x rows) margins of model ``m`` with coefficients theta (vectors x (columns + 1))."""
    shift = theta[:, -1] - (theta[:, :-1] * (space.mean[m] * space.scale[m])).sum(1)
    return np.stack([np.bincount(row, v * t[col], n) + s for t, s in zip(theta[:, :-1], shift)])


def _probabilities(z: np.ndarray) -> np.ndarray:
    if len(z) == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(z[0], -700, 700)))
        return np.stack([1.0 - p, p])
    e = np.exp(z - z.max(0))
    return e / e.sum(0)


def _sparse(batch: pa.RecordBatch) -> tuple:
    fold, label = batch.column("fold").to_numpy(), batch.column("label_idx").to_numpy().astype(int)
    cols = batch.column("cols")
    size = np.diff(cols.offsets.to_numpy())
    return (fold, label, np.repeat(np.arange(len(size)), size), cols.flatten().to_numpy(),
            batch.column("vals").flatten().to_numpy(), len(size))


def _runs(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, ``size`` of them each."""
    out, some = np.zeros(len(size)), np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some])
    return out


def pack(rows: DataFrame, space: Space) -> DataFrame:
    """The rows as blocks of arrays: fold, label, number of entries, entries by row, and with ``unit``
    the length of each row for each model."""
    squares = space.scale * space.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                fold, label, row, col, val, n = _sparse(whole.slice(at, BLOCK))
                size = np.bincount(row, minlength=n)
                length = np.zeros(0)
                if space.unit:
                    length = np.stack([np.sqrt(_runs(val * val * s[col], size)) for s in squares])
                    length[length == 0] = 1.0
                arrays = (fold.astype(np.int32), label.astype(np.int32), size.astype(np.int32), col.astype(np.int32), val.astype(float), length)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=names)

    names = ["fold", "label", "size", "col", "val", "length"]
    return kept(rows.select("fold", "label_idx", "cols", "vals").mapInArrow(run, ", ".join(f"{x} binary" for x in names)), "blocks")


def _blocks(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    kinds = {"val": float, "length": float}
    columns = [[np.frombuffer(x.as_buffer(), kinds.get(name, np.int32)) for x in batch.column(name)] for name in batch.schema.names]
    yield from map(list, zip(*columns))


def _pass(blocks: DataFrame, space: Space, thetas: dict[int, np.ndarray]) -> tuple[dict[int, float], dict[int, np.ndarray]]:
    """Loss and gradient (without the penalty) of the given models over packed rows, in one job."""
    d, many = space.scale.shape[1], space.vectors
    wide = d + 2  # the columns, the intercept, the loss
    models = list(thetas)
    # (models x vectors) x columns, for unscaled values
    W = np.vstack([thetas[m][:, :-1] * space.scale[m] for m in models])
    shift = np.concatenate([thetas[m][:, -1] - (thetas[m][:, :-1] * (space.mean[m] * space.scale[m])).sum(1) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, free, loss = np.zeros((len(shift), d)), np.zeros(len(shift)), np.zeros(len(models))
        for batch in batches:
            for fold, label, size, col, val, length in _blocks(batch):
                n = len(fold)
                row = np.repeat(np.arange(n), size)
                if d <= DENSE:
                    X = np.bincount(row * d + col, val, n * d).reshape(n, d)
                    z = W @ X.T
                else:
                    z = np.stack([_runs(val * w[col], size) for w in W])
                if space.unit:
                    by = np.repeat(length.reshape(-1, n)[models], many, axis=0)
                    z /= by
                z += shift[:, None]
                r = np.empty_like(z)
                for i, m in enumerate(models):
                    at = slice(i * many, (i + 1) * many)
                    weight = np.where(fold == m, 0.0, space.weight[m][label])
                    p = _probabilities(z[at])
                    loss[i] -= (weight * np.log(np.maximum(p[label, np.arange(n)], 1e-300))).sum()
                    if many == 1:
                        r[i] = weight * (p[1] - (label == 1))
                    else:
                        p[label, np.arange(n)] -= 1.0
                        r[at] = weight * p
                free += r.sum(1)
                if space.unit:
                    r /= by
                if d <= DENSE:
                    grad += r @ X
                else:
                    for g, x in zip(grad, r):
                        g += np.bincount(col, val * x[row], d)
        for i, m in enumerate(models):
            at = slice(i * many, (i + 1) * many)
            total = np.hstack([grad[at] * space.scale[m], free[at, None], np.zeros((many, 1))])
            total[0, -1] = loss[i]
            some = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), m, np.int32)), pa.array(some), pa.array(total.ravel()[some])], names=["m", "at", "v"])

    sums = blocks.mapInArrow(run, "m int, at long, v double").groupBy("m", "at").agg(F.sum("v").alias("v"))
    got = sums.toPandas()  # one number per model and coefficient
    loss, gradient = {}, {}
    for m in thetas:
        mine = got[got.m == m]
        flat = np.bincount(mine["at"].to_numpy(np.int64), mine["v"].to_numpy(float), many * wide).reshape(many, wide)
        g = flat[:, :-1].copy()
        # the entries are scaled above, the centers are constant per column
        g[:, :-1] -= (space.mean[m] * space.scale[m]) * flat[:, -2:-1]
        loss[m], gradient[m] = float(flat[0, -1]), g
    return loss, gradient


class _Lbfgs:
    """One model's descent; ``trial`` is the point to evaluate next."""

    def __init__(self, shape: tuple[int, int]) -> None:
        self.x, self.f, self.g = np.zeros(shape), None, None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.trial, self.t, self.done = self.x, 1.0, False

    def _direction(self) -> np.ndarray:
        q, alphas = -self.g.ravel(), []
        for s, y in reversed(self.steps):
            a = s @ q / (s @ y)
            alphas.append(a)
            q = q - a * y
        if self.steps:
            s, y = self.steps[-1]
            q = q * (s @ y) / (y @ y)
        else:
            q = q / max(1.0, np.linalg.norm(self.g))
        for (s, y), a in zip(self.steps, reversed(alphas)):
            q = q + s * (a - y @ q / (s @ y))
        return q.reshape(self.x.shape)

    def tell(self, f: float, g: np.ndarray) -> None:
        f += 0.5 * (self.trial[:, :-1] ** 2).sum()
        g = g.copy()
        g[:, :-1] += self.trial[:, :-1]
        if self.f is None:
            self.start = max(1.0, np.abs(g).max())
        elif f > self.f + 1e-4 * self.t * (self.g * self.d).sum():
            self.t /= 2.0
            self.trial = self.x + self.t * self.d
            self.done = self.t < 1e-10
            return
        else:
            s, y = (self.trial - self.x).ravel(), (g - self.g).ravel()
            if s @ y > 1e-12 * (y @ y):
                self.steps = [*self.steps[1 - MEMORY:], (s, y)]
        small = self.f is not None and self.f - f <= 1e-11 * max(1.0, abs(f))
        self.x, self.f, self.g = self.trial, f, g
        self.done = bool(small or np.abs(g).max() <= TOLERANCE * self.start)
        self.d, self.t = self._direction(), 1.0
        self.trial = self.x + self.d


def fit_folds(rows: DataFrame, space: Space) -> tuple[np.ndarray, int]:
    """Coefficients (models x vectors x (columns + 1), the intercept last) and the number of passes."""
    shape = (space.vectors, space.scale.shape[1] + 1)
    rows = pack(rows, space)
    runs = {m: _Lbfgs(shape) for m in range(space.models)}
    passes = 0
    while passes < MAX_PASSES and (todo := {m: r.trial for m, r in runs.items() if not r.done}):
        loss, gradient = _pass(rows, space, todo)
        passes += 1
        for m in todo:
            runs[m].tell(loss[m], gradient[m])
    return np.stack([runs[m].x for m in range(space.models)]), passes


def predict_folds(rows: DataFrame, space: Space, theta: np.ndarray) -> DataFrame:
    """(row_id, label_idx, probability, prediction): each row by the model that did not see it."""
    src = rows.select("row_id", "fold", "label_idx", "cols", "vals")
    schema = T.StructType([src.schema["row_id"], src.schema["label_idx"], T.StructField("probability", T.ArrayType(T.DoubleType())),
                           T.StructField("prediction", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, label, row, col, val, n = _sparse(batch)
            out = np.zeros((n, space.weight.shape[1]))
            for m in np.unique(fold):
                mine = fold == m
                p = _probabilities(_margins(space, m, theta[m], row, col, _values(space, m, row, col, val, n), n)).T
                out[mine] = p[mine]
            offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("label_idx"), pa.ListArray.from_arrays(offsets, out.ravel()),
                                              pa.array(out.argmax(1).astype(float))], names=schema.names)

    return src.mapInArrow(run, schema)
