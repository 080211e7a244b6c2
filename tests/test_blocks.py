"""Terms are not shuffled; a pass of the regressions reads packed blocks and sums what the formula says."""

import numpy as np

from rowaudit.operators import logistic, text


def test_terms_stay_with_their_document(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (2, "fox green"), (3, None)], "row_id long, t string")
    out = text.tfidf(df, "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(doc" in x and "term" in x]
    assert {(r.row_id, r.term) for r in out.collect()} == {(1, "red"), (1, "fox"), (2, "blue"), (2, "fox"), (2, "green")}
    assert text.doc_terms(df, "t").where("doc = 2 and term = 'fox'").first().tf == 2  # rows of one id are one document


def test_a_pass_over_blocks(spark):
    rng = np.random.default_rng(0)
    for d, unit, classes in ((5, False, 3), (90, True, 3), (90, False, 2)):
        n, k = 4500, 2
        X = np.where(rng.random((n, d)) < 0.1, rng.normal(size=(n, d)), 0.0)
        X[::50] = 0.0
        fold, y = rng.integers(0, k, n), rng.integers(0, classes, n)
        rows = spark.createDataFrame([(i, int(fold[i]), int(y[i]), np.flatnonzero(X[i]).tolist(), X[i][X[i] != 0].tolist()) for i in range(n)],
                                     "row_id long, fold int, label_idx int, cols array<int>, vals array<double>").coalesce(1)
        space = logistic.Space(rng.random((k, d)) + 0.5, np.zeros((k, d)) if unit else rng.normal(size=(k, d)), rng.random((k, classes)), unit=unit)
        thetas = {m: rng.normal(size=(space.vectors, d + 1)) for m in range(k)}
        blocks = logistic.pack(rows, space)
        assert blocks.count() <= n // 500
        loss, gradient = logistic._pass(blocks, space, thetas)
        for m, theta in thetas.items():
            V = (X - space.mean[m]) * space.scale[m]
            if unit:
                V = V / np.maximum(np.linalg.norm(V, axis=1, keepdims=True), 1e-300)
            z = V @ theta[:, :-1].T + theta[:, -1]
            e = np.exp(np.hstack([np.zeros((n, 1)), z]) if classes == 2 else z)
            p, w = e / e.sum(1, keepdims=True), np.where(fold == m, 0.0, space.weight[m][y])
            r = w[:, None] * (p - np.eye(classes)[y])
            r = r[:, 1:] if classes == 2 else r
            assert np.isclose(loss[m], -(w * np.log(p[np.arange(n), y])).sum())
            assert np.allclose(gradient[m], np.hstack([r.T @ V, r.sum(0)[:, None]]))
