"""Rules that must not depend on the size or the spread of the input."""

from pyspark.sql import functions as F

from rowaudit.operators import forest, lof
from rowaudit.operators.clean import ffill_bfill
from rowaudit.operators.poison import poison_classification


def test_fill_with_sparse_and_negative_ids(spark):
    rows = [(-10**12, None), (-5, "b"), (3, None), (10**9, None), (10**15, "e"), (10**18, None)]
    df = spark.createDataFrame(rows, "row_id long, v string")
    out = ffill_bfill(df, "v", bucket_rows=2, parse=False).orderBy("row_id").collect()
    assert [r.v for r in out] == ["b", "b", "b", "b", "e", "e"]


def test_label_flip_with_many_labels(spark):
    df = spark.range(12_000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"),
                                    F.concat(F.lit("l"), F.col("id")).alias("y"), F.col("id").alias("was"))
    out = poison_classification(df, "y", ["x"], p=0.05, shuffle=False)
    assert out.count() == 12_000
    flipped = out.where("poison_phase = 3")
    assert flipped.count() == 200
    assert flipped.where("y = concat('l', was) or y is null").count() == 0
    assert out.where("(poison_phase is null or poison_phase < 3) and y <> concat('l', was)").count() == 0


def test_label_flip_leaves_null_and_single_labels(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "a").alias("y"))
    out = poison_classification(df, "y", ["x"], p=0.3, shuffle=False)
    assert out.where("y is null").count() == 150


def test_forest_draws_from_all_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"))
    m = forest.fit(df, ["x"], n_trees=20, max_samples=64)
    root = m.nodes[m.nodes.node == 0]
    assert m.n_trees == 20 and (root["size"] == 64).all()


def test_lof_keeps_rows_that_are_alone(spark):
    rows = [(i, "a", [float(i), 0.0]) for i in range(6)] + [(6, "b", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "row_id long, g string, v array<double>")
    out = {r.row_id: r.lof for r in lof.lof_scores(df, "v", k=2, by="g").collect()}
    assert len(out) == 7 and out[6] is None and all(out[i] is not None for i in range(6))
