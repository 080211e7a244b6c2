"""Property tests for the random / iterative detectors (no SQL oracle)."""

import numpy as np
from pyspark.sql import functions as F

from rowaudit.operators import forest, lof, svm
from rowaudit.operators.ensemble import ensemble
from rowaudit.operators.poison import gaussian_features, inject_shift


def _gauss(spark, n=2000):
    base = spark.range(n).withColumnRenamed("id", "row_id")
    return inject_shift(gaussian_features(base), "feature1", 0.05, 10.0, 42)


COLS = ["feature1", "feature2", "feature3"]


def test_forest_ranks_injected_rows_on_top(spark):
    g = _gauss(spark)
    s = forest.score(g, forest.fit(g, COLS), "s").toPandas()
    top = s.nlargest(100, "s")
    assert top["is_actual_poisoned"].mean() > 0.8


def test_forest_same_flags_under_any_partitioning(spark):
    g = _gauss(spark, 1000)
    a = forest.outliers(g.repartition(3), COLS).where("p2iso is not null").select("row_id").collect()
    b = forest.outliers(g.repartition(11), COLS).where("p2iso is not null").select("row_id").collect()
    assert sorted(r[0] for r in a) == sorted(r[0] for r in b)


def test_forest_flag_rate_is_contamination(spark):
    g = _gauss(spark, 1000)
    n = forest.outliers(g, COLS, 0.05).where("p2iso is not null").count()
    assert 45 <= n <= 55


def test_knn_matches_brute_force_with_several_blocks(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(300)], "row_id long, v array<double>")
    got = lof.knn(df, "v", k=5, block_rows=70).toPandas()
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in (0, 17, 299):
        want = set(np.argsort(d[i])[:5])
        assert set(got[got.row_id == i].nbr_id) == want


def test_lof_highlights_isolated_point(spark):
    rows = [(i, [float(i % 10), float(i // 10)]) for i in range(100)] + [(100, [50.0, 50.0])]
    df = spark.createDataFrame(rows, "row_id long, v array<double>")
    s = lof.lof_scores(df, "v", k=5).orderBy(F.desc("lof")).first()
    assert s["row_id"] == 100


def test_one_class_svm_scores_shifted_rows_higher(spark):
    g = _gauss(spark, 1500)
    s = svm.score(g, svm.fit(g, COLS), "s").toPandas()
    assert s[s.is_actual_poisoned == 1]["s"].mean() > s[s.is_actual_poisoned == 0]["s"].mean()


def test_ensemble_finds_shift(spark):
    g = _gauss(spark, 1500)
    out = ensemble(g, COLS).toPandas()
    tp = ((out.is_actual_poisoned == 1) & (out.is_predicted_poisoned == 1)).sum()
    assert tp / out.is_actual_poisoned.sum() > 0.6


def test_label_audit_flags_flipped_labels(spark):
    from rowaudit.operators.audit import audit_table
    from rowaudit.operators.poison import poison_classification
    base = spark.range(1200).withColumnRenamed("id", "row_id")
    g = gaussian_features(base).withColumn("y", F.when(F.col("feature1") > 0, "pos").otherwise("neg"))
    p = poison_classification(g, "y", ["feature2"], p=0.1, shuffle=False)
    clean = p.where("poison_phase is null or poison_phase = 3")
    out = audit_table(clean, ["feature1"], {"feature1": "Numerical"}, "y").toPandas()
    flipped = out.merge(p.select("row_id", "poison_phase").toPandas(), on="row_id")
    assert flipped[flipped.poison_phase == 3]["loss"].mean() > flipped[flipped.poison_phase.isna()]["loss"].mean()


def test_grid_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(size=(1500, 3)), rng.normal(size=(400, 3)) * 0.1 + 3.0, rng.uniform(-8, 8, size=(100, 3))])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "row_id long, v array<double>")
    got = lof.knn(df, "v", k=7, block_rows=300, cell_rows=50).toPandas()
    assert len(got) == len(X) * 7
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in list(range(0, len(X), 97)) + [1950, 1999]:
        want = np.sort(d[i])[:7]
        have = np.sort(got[got.row_id == i].dist.to_numpy())
        assert np.allclose(have, want, rtol=0, atol=1e-12)


def test_one_class_svm_is_one_model_under_any_partitioning(spark):
    g = _gauss(spark, 1500)
    scores = []
    for parts in (1, 13):
        d = g.repartition(parts)
        scores.append(svm.score(d, svm.fit(d, COLS, nu=0.1), "s").orderBy("row_id").toPandas().s.to_numpy())
    assert np.allclose(*scores, rtol=0, atol=1e-9)
    assert (scores[0] > 1e-12).sum() == 150  # a nu share lies outside


def test_one_class_svm_sums_cover_every_row(spark):
    """The cells' weights are those of all rows: a heavy value far from the landmarks counts."""
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(size=(400, 2)), np.tile([[6.0, 6.0]], (600, 1))])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "row_id long, a double, b double")
    s = svm.score(df, svm.fit(df, ["a", "b"], landmarks=16), "s").toPandas().sort_values("row_id").s.to_numpy()
    assert s[400:].max() < np.median(s[:400])
