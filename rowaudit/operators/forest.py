"""Isolation Forest (Liu, Ting & Zhou, 2008) on Spark.

Each tree sees ``psi`` rows (<= 256) drawn from the whole table by a hash of tree
and row id, and the trees are grown in parallel, one group of rows per tree.  The
rows that are shuffled number about ``trees * psi`` at any table size.  The node table
(<= trees * (2*psi - 1) rows) is broadcast and every row is scored in a
map-only ``mapInPandas`` pass over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.operators.flags import finding
from rowaudit.operators.stats import as_matrix

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")
EULER = 0.5772156649


def c_factor(m) -> np.ndarray:
    """Average unsuccessful-search path length in a BST of m points."""
    m = np.asarray(m, dtype=float)
    out = np.zeros_like(m)
    big = m > 2
    out[big] = 2.0 * (np.log(m[big] - 1.0) + EULER) - 2.0 * (m[big] - 1.0) / m[big]
    out[m == 2] = 1.0
    return out


def _grow_tree(X: np.ndarray, rng: np.random.Generator, limit: int):
    feats, thrs, lefts, rights, sizes, depths = [], [], [], [], [], []

    def new(size, depth):
        feats.append(-1); thrs.append(0.0); lefts.append(-1); rights.append(-1)
        sizes.append(size); depths.append(depth)
        return len(feats) - 1

    stack = [(np.arange(len(X)), 0, new(len(X), 0))]
    while stack:
        idx, depth, me = stack.pop()
        if depth >= limit or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        varying = np.flatnonzero(hi > lo)
        if len(varying) == 0:
            continue
        f = int(varying[rng.integers(len(varying))])
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        li, ri = idx[go_left], idx[~go_left]
        feats[me], thrs[me] = f, t
        lefts[me] = new(len(li), depth + 1)
        rights[me] = new(len(ri), depth + 1)
        stack.append((li, depth + 1, lefts[me]))
        stack.append((ri, depth + 1, rights[me]))
    return feats, thrs, lefts, rights, sizes, depths


class IsolationForestModel:
    def __init__(self, nodes: pd.DataFrame, cols: list[str] | str, psi: int):
        self.nodes, self.cols, self.psi = nodes, cols, psi

    @property
    def n_trees(self) -> int:
        return int(self.nodes["tree"].nunique())

    def arrays(self):
        nd = self.nodes.sort_values(["tree", "node"])
        trees = []
        for _, g in nd.groupby("tree", sort=True):
            trees.append((g["feature"].to_numpy(np.int64), g["threshold"].to_numpy(float),
                          g["left"].to_numpy(np.int64), g["right"].to_numpy(np.int64),
                          c_factor(g["size"].to_numpy(float))))
        return trees

    def save(self, spark, path: str):
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        one = isinstance(self.cols, str)  # an array column has no place
        rows = [(c, None if one else i, self.psi) for i, c in enumerate([self.cols] if one else self.cols)]
        spark.createDataFrame(rows, "col string, pos int, psi int").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> "IsolationForestModel":
        meta = spark.read.parquet(f"{path}/meta").orderBy("pos").collect()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(nodes, meta[0]["col"] if meta[0]["pos"] is None else [r["col"] for r in meta], int(meta[0]["psi"]))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: independent bits from a counter added to a hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) * 2.0 ** -53


def draw_trees(h: np.ndarray, n_trees: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, draw): the trees that rows of hash ``h`` join, each with probability ``share``
    and independently, by geometric skips; a row that joins none costs its first skip alone."""
    if share >= 1.0:
        row, tree = np.repeat(np.arange(len(h)), n_trees), np.tile(np.arange(n_trees), len(h))
        return row, tree, _mix(h[row] + tree.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    rows, at, step = np.arange(len(h)), np.full(len(h), -1), 0
    out_r, out_t = [], []
    while len(rows):
        bits = h[rows] if step == 0 else _mix(h[rows] + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        skip = np.floor(np.log1p(-_uniform(bits)) / np.log1p(-share))
        at = at + 1 + np.minimum(skip, n_trees).astype(np.int64)
        rows, at = rows[at < n_trees], at[at < n_trees]
        out_r.append(rows)
        out_t.append(at)
        step += 1
    row, tree = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_r, out_t))
    return row, tree, _mix(h[row] + (tree + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def fit(df: DataFrame, cols: list[str] | str, n_trees: int = 200, max_samples: int = 256,
        seed: int = 42, n: int | None = None) -> IsolationForestModel:
    """Grow ``n_trees`` isolation trees on seeded subsamples of ``df``; ``cols`` are number columns, or
    the name of an array column.

    A row joins each tree with a probability that lets in a few more than ``psi`` rows on
    average (six standard deviations); the tree takes the ``psi`` of smallest draw.  One
    hash per row gives its first tree by a geometric skip, and the rows that skip all
    trees stop there.  Every row can be drawn, nothing but the grown nodes reaches the driver.
    """
    n = df.count() if n is None else n
    psi = int(min(max_samples, n))
    limit = int(math.ceil(math.log2(max(psi, 2))))
    share = min(1.0, (psi + 6.0 * math.sqrt(psi) + 16.0) / max(n, 1))
    inputs = [F.col(cols).cast("array<double>").alias(cols)] if isinstance(cols, str) else [F.col(c).cast("double").alias(c) for c in cols]
    base = df.select("row_id", *inputs, F.xxhash64(F.lit(seed), "row_id").alias("_h"))
    if share < 1.0:  # the first skip leaves the trees unless the uniform number is below this
        some = -math.expm1(n_trees * math.log1p(-share))
        base = base.where(F.shiftrightunsigned("_h", 11) * F.lit(2.0 ** -53) <= F.lit(some))

    def draw(batches):
        for pdf in batches:
            row, tree, order = draw_trees(pdf["_h"].to_numpy(np.int64).view(np.uint64), n_trees, share)
            out = pdf.drop(columns="_h").iloc[row]
            yield out.assign(tree=tree.astype(np.int32), draw=(order >> np.uint64(1)).astype(np.int64))

    schema = T.StructType([*base.drop("_h").schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("draw", T.LongType())])
    drawn = base.mapInPandas(draw, schema)
    drawn = drawn.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree")  # not to be coalesced

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        X = as_matrix(pdf.sort_values(["draw", "row_id"])[:psi], cols)
        f, t, lft, rgt, sz, d = _grow_tree(X, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(f), dtype=np.int32), "feature": f,
                             "threshold": t, "left": lft, "right": rgt, "size": sz, "depth": d})

    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    return IsolationForestModel(nodes, cols, psi)


def score(df: DataFrame, model: IsolationForestModel, name: str = "iso_score") -> DataFrame:
    """Anomaly score s = 2^(-E[h(x)]/c(psi)) in (0, 1]; higher = more isolated."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((model.arrays(), model.cols, model.psi))
    schema = T.StructType(list(df.schema.fields) + [T.StructField(name, T.DoubleType())])

    def run(batches):
        trees, cols, psi = bc.value
        cpsi = float(c_factor([psi])[0]) or 1.0
        for pdf in batches:
            X = as_matrix(pdf, cols)
            n = len(X)
            h = np.zeros(n)
            rows = np.arange(n)
            for feat, thr, left, right, cleaf in trees:
                node = np.zeros(n, dtype=np.int64)
                depth = np.zeros(n)
                while True:
                    f = feat[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = X[rows, np.maximum(f, 0)] < thr[node]
                    nxt = np.where(go_left, left[node], right[node])
                    node = np.where(inner, nxt, node)
                    depth += inner
                h += depth + cleaf[node]
            pdf[name] = np.power(2.0, -(h / len(trees)) / cpsi)
            yield pdf

    return df.mapInPandas(run, schema)


def contamination_for(n: int) -> float:
    """Tabular phase-2 rule: min(0.05, max(0.01, 1/n))."""
    return min(0.05, max(0.01, 1.0 / n))


def outliers(df: DataFrame, cols: list[str], contamination: float | None = None, n_trees: int = 200,
             seed: int = 42, name: str = "p2iso", reason: str = "IsolationForest outlier",
             keep_score: bool = False) -> DataFrame:
    """Flag rows whose score is strictly above the (1 - contamination) quantile."""
    from rowaudit.operators.stats import exact_quantile
    from rowaudit.session import cut_lineage, spread
    df = spread(df)
    n = df.count()
    c = contamination_for(n) if contamination is None else contamination
    model = fit(df, cols, n_trees=n_trees, seed=seed, n=n)
    scored = cut_lineage(score(df, model, "_iso"))
    thr = exact_quantile(scored, "_iso", 1.0 - c)
    out = scored.withColumn(name, F.when(F.col("_iso") > F.lit(thr), finding(0, None, reason, F.col("_iso"))))
    return out.withColumnRenamed("_iso", "iso_score") if keep_score else out.drop("_iso")
