"""Label audit: folds fitted together equal separate fits; categories of any number; gates."""

import numpy as np
from pyspark.sql import functions as F

from rowaudit.operators import audit, clean
from rowaudit.operators.logistic import Space, fit_folds

TYPES = {"a": "Numerical", "b": "Numerical", "c": "Categorical"}


def _data(spark, classes, n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.normal(), rng.normal() * 3 + 1, rng.choice(["x", "y", "z", None])
        y = int(np.clip(round(a + (c == "y") + rng.normal() * 0.7), 0, classes - 1))
        rows.append((i, float(a), None if i % 17 == 0 else float(b), c, f"k{y}"))
    return spark.createDataFrame(rows, "row_id long, a double, b double, c string, y string")


def _newton(X, y, w, classes):
    """sum(w * loss) + |b|^2 / 2 with free intercepts, by Newton steps on a dense matrix."""
    n, d = X.shape
    many = 1 if classes == 2 else classes
    Z, theta = np.hstack([X, np.ones((n, 1))]), np.zeros((many, d + 1))
    pen = np.append(np.ones(d), 1e-9)  # the softmax intercepts are only known up to a constant
    for _ in range(60):
        m = Z @ theta.T
        if many == 1:
            p = 1 / (1 + np.exp(-m))
            r, t = p - (y == 1)[:, None], 1
        else:
            e = np.exp(m - m.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            r = p - np.eye(classes)[y]
        g = (w[:, None] * r).T @ Z + theta * pen
        H = np.zeros((many * (d + 1),) * 2)
        for i in range(many):
            for j in range(many):
                q = w * p[:, i] * ((i == j) - p[:, j])
                H[i * (d + 1):(i + 1) * (d + 1), j * (d + 1):(j + 1) * (d + 1)] = (Z * q[:, None]).T @ Z + (i == j) * np.diag(pen)
        theta = theta - np.linalg.solve(H, g.ravel()).reshape(theta.shape)
    return theta


def test_folds_together_equal_separate_fits(spark):
    for classes in (2, 3):
        df = _data(spark, classes)
        d, labels = audit.index_labels(df, "y")
        design = audit.sparse_rows(d, ["a", "b", "c"], TYPES, "y")
        assert design.names == ["a", "b", "c=x", "c=y", "c=z"] and len(labels) == classes
        pred = audit.logistic_out_of_fold(design, "y", classes, 4).orderBy("row_id").toPandas()
        pdf = df.orderBy("row_id").toPandas()
        X = np.column_stack([pdf.a, pdf.b.fillna(0.0), *[(pdf.c == v).astype(float) for v in "xyz"]])
        X = (X - X.mean(0)) / X.std(0)
        y = pdf.y.str[1:].astype(int).to_numpy()
        from rowaudit.operators.rows import stratified_folds
        fold = stratified_folds(df, "y", 4).orderBy("row_id").toPandas().fold.to_numpy()
        P = np.stack(pred.probability)
        for f in range(4):
            tr = fold != f
            count = np.bincount(y[tr], minlength=classes)
            theta = _newton(X[tr], y[tr], (tr.sum() / (classes * count))[y[tr]], classes)
            m = np.hstack([X[~tr], np.ones(((~tr).sum(), 1))]) @ theta.T
            m = np.hstack([np.zeros_like(m), m]) if classes == 2 else m
            want = np.exp(m - m.max(1, keepdims=True))
            assert np.allclose(P[~tr], want / want.sum(1, keepdims=True), atol=2e-4)
        assert (pred.prediction == P.argmax(1)).all()


def test_passes_do_not_grow_with_the_folds(spark):
    df = _data(spark, 3)
    d, _ = audit.index_labels(df, "y")
    design = audit.sparse_rows(d, ["a", "b", "c"], TYPES, "y")
    passes = []
    for k in (2, 10):
        rows = design.rows.withColumn("fold", (F.col("row_id") % k).cast("int")).persist()
        space = Space(np.tile(1 / design.sd, (k, 1)), np.tile(design.mean, (k, 1)), np.ones((k, 3)))
        passes.append(fit_folds(rows, space)[1])
        rows.unpersist()
    assert passes[1] <= 2 * passes[0]


def test_hundred_thousand_categories(spark):
    n = 120_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id") % 100_000).alias("c"),
                               F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("y"))
    out = audit.audit_table(df, ["c"], {"c": "Categorical"}, "y", folds=2)
    assert out.count() == n and out.where("p3 is not null").count() <= 0.05 * n + 1


def test_one_hot_rows(spark):
    rows = [(1, "b", "x"), (2, None, "x"), (3, "a", None), (3, "a", None)]
    got = clean.one_hot_rows(spark.createDataFrame(rows, "row_id long, c string, d string"), ["c", "d"]).collect()
    assert sorted(map(tuple, got)) == [(1, "c", "b", 1), (1, "d", "x", 2), (2, "d", "x", 2), (3, "c", "a", 0), (3, "c", "a", 0)]


def test_gates_and_null_labels(spark):
    few = _data(spark, 2, 19)
    lone = _data(spark, 2, 60).unionByName(spark.createDataFrame([(99, 0.0, 0.0, "x", "only")], "row_id long, a double, b double, c string, y string"))
    for df in (few, lone):
        for fn in (audit.audit_table, audit.model_disagreement, audit.gbt_probabilities):
            assert fn(df, ["a"], TYPES, "y") is None
    null = _data(spark, 2, 60).withColumn("y", F.when(F.col("row_id") > 5, F.col("y")))
    assert audit.audit_table(null, ["a", "c"], TYPES, "y").count() == 54


def test_gbt_of_three_classes(spark):
    df = _data(spark, 3, 240)
    out = audit.gbt_probabilities(df, ["a", "c"], TYPES, "y", folds=2, max_iter=3).toPandas()
    assert len(out) == 240 and out.p_true.between(0, 1).all() and out.p_true.mean() > 0.4


def test_text_vocabulary_is_that_of_the_training_rows(spark):
    rows = [(i, f"common word{i % 2} {'rare' if i == 0 else 'usual'} usual", "k" + str(i % 2)) for i in range(24)]
    df = spark.createDataFrame(rows, "row_id long, t string, y string")
    d, _ = audit.index_labels(df, "y")
    from rowaudit.functions.text import tokens
    toks = d.withColumn("fold", (F.col("row_id") % 3).cast("int")).withColumn("toks", tokens(F.col("t")))
    terms, space = audit.text_space(toks, 3, 2, vocabulary=4)
    assert space.scale[0][terms["usual"]] > 0 and "rare" not in terms or space.scale[0][terms["rare"]] == 0
    assert np.isclose(space.scale[1][terms["common"]], 1.0)
    out = audit.audit_text(df, "t", "y").toPandas()
    assert len(out) == 24 and out.p_true.min() > 0.5
