"""Ranks and folds keep null labels, negative and sparse ids, and use many tasks."""

from rowaudit.operators.rows import global_rank, shuffle_with_mapping, stratified_folds


def _rows(spark):
    rows = [(i * 1_000_003 - 7_000_000, None if i % 10 == 0 else f"c{i % 3}") for i in range(3000)]
    return spark.createDataFrame(rows, "row_id long, label string")


def test_folds_keep_null_labels(spark):
    df = _rows(spark)
    for shuffle in (True, False):
        out = stratified_folds(df, "label", 5, shuffle=shuffle).toPandas()
        assert len(out) == 3000 and out.row_id.nunique() == 3000
        sizes = out.groupby([out.label.fillna("none"), "fold"]).size().unstack()
        assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_unshuffled_folds_are_blocks_in_row_order(spark):
    out = stratified_folds(_rows(spark), "label", 5, shuffle=False).toPandas().sort_values("row_id")
    for _, g in out.groupby(out.label.fillna("none")):
        assert g.fold.is_monotonic_increasing


def test_rank_is_not_one_task(spark):
    df = shuffle_with_mapping(_rows(spark))
    assert sorted(r.new_id for r in df.collect()) == list(range(3000))
    ranked = global_rank(_rows(spark).selectExpr("*", "md5(cast(row_id as string)) k"), "k", by=["label"])
    assert ranked.count() == 3000
