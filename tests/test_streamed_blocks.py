"""The search of all blocks: streamed past the queries, without a shuffle of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowaudit.operators import lof


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lof, "PAIR_BYTES", 60 * (8 * 4 + 64))
    monkeypatch.setattr(lof, "prunes", lambda *_: False)


def _table(spark, X, groups, tag=""):
    rows = [(f"{tag}{i:03d}", g, x.tolist()) for i, (x, g) in enumerate(zip(X, groups))]
    return spark.createDataFrame(rows, "row_id string, g string, vec array<double>")


def _brute(Q, qg, R, rg, k, skip=False):
    out = {}
    for i, x in enumerate(Q):
        mine = [j for j in range(len(R)) if rg[j] == qg[i] and not (skip and i == j)]
        d = np.sqrt(((R[mine] - x) ** 2).sum(1)) if mine else np.zeros(0)
        for j in sorted(range(len(mine)), key=lambda j: (d[j], mine[j]))[:k]:
            out[f"{i:03d}", f"{mine[j]:03d}"] = d[j]
    return out


def _same(got, want):
    got = {(r["row_id"][-3:], r["nbr_id"][-3:]): r["dist"] for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_groups_of_several_blocks_and_of_one(spark, small_blocks):
    X = np.random.default_rng(8).integers(0, 6, size=(260, 4)).astype(float)  # ties and equal vectors
    groups = ["a"] * 130 + ["b"] * 100 + ["c"] * 20 + [None] * 10
    _same(lof.knn(_table(spark, X, groups), "vec", 5, by="g"), _brute(X, groups, X, groups, 5, skip=True))


def test_other_queries(spark, small_blocks):
    rng = np.random.default_rng(9)
    Q, R = rng.normal(size=(150, 4)), rng.normal(size=(200, 4))
    R[150:] = R[:50]
    qg, rg = ["a"] * 100 + ["b"] * 50, ["a"] * 170 + ["b"] * 30
    _same(lof.knn_between(_table(spark, Q, qg, "q"), _table(spark, R, rg), "vec", 4, by="g"), _brute(Q, qg, R, rg, 4))


def test_pairs_of_blocks_are_not_shuffled(spark, small_blocks):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(10).normal(size=(300, 4)))], "row_id long, vec array<double>")
    points = lof._points(df, "vec", None, 6)[1]
    found = lof._search_all(points, points, 6)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert found.count() == 300


def test_shuffle_files_of_a_kept_table_are_dropped(spark):
    from rowaudit.session import _CLEANUP, kept, shuffles_dropped
    before = spark.conf.get(_CLEANUP, None)
    with shuffles_dropped(spark):
        assert spark.conf.get(_CLEANUP) == "true"
    assert spark.conf.get(_CLEANUP, None) == before
    assert kept(spark.range(50).groupBy((F.col("id") % 7).alias("g")).count()).count() == 7
