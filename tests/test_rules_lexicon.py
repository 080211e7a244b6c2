"""Missing columns, repeated lexicon words and tables too small to poison."""

import pytest

from rowaudit.functions import lexicon as lx
from rowaudit.operators.poison import poison_classification
from rowaudit.operators.rules import TextRules, check_text


def test_checks_need_their_column(spark):
    d = spark.createDataFrame([(1, "some text here")], "row_id long, text string")
    with pytest.raises(ValueError, match="needs the column"):
        check_text(d, "text", TextRules(max_perplexity=10.0))
    # the language check reads the text where there is no language column
    assert check_text(d, "text", TextRules(language="en", flag_gibberish=False)).first().p1.reason == "Language mismatch"


def test_lexicon_plans_agree(spark, monkeypatch):
    lex = spark.createDataFrame([("good", 0.5, 0.2), ("good", 1.0, 0.4), ("odd", None, 0.9), (None, 1.0, 1.0), ("bad", -1.0, None)],
                                "word string, polarity double, subjectivity double")
    d = spark.createDataFrame([(1, "good odd bad"), (2, None), (3, "nothing known")], "row_id long, text string")
    for which, want in (("polarity", (0.75 - 1.0) / 2), ("subjectivity", (0.3 + 0.9) / 2)):
        for limit in (50_000, 0):
            monkeypatch.setattr(lx, "INLINE_LIMIT", limit)
            got = {r.row_id: r[which] for r in lx.lexicon_scores(d, "text", lex, which).collect()}
            assert got == {1: pytest.approx(want), 2: 0.0, 3: 0.0}
    monkeypatch.setattr(lx, "INLINE_LIMIT", 50_000)
    assert [r.polarity for r in lx.lexicon_scores(d, "text", lex.limit(0), "polarity").collect()] == [0.0] * 3


def test_small_table_keeps_the_schema(spark):
    rows = [(i, float(i), "a" if i % 2 else "b") for i in range(60)]
    d = spark.createDataFrame(rows, "row_id long, x double, y string")
    big = poison_classification(d, "y", ["x"], 0.1)
    small = poison_classification(d.where("row_id < 3"), "y", ["x"], 0.1)
    assert small.columns == big.columns and small.schema["x"].dataType == big.schema["x"].dataType
    assert sorted(r.row_id for r in small.collect()) == [0, 1, 2]
    assert [r.is_actual_poisoned for r in small.collect()] == [0, 0, 0]


def test_reports_keep_one_row_with_several_findings(spark):
    from rowaudit.operators import flags as fl
    df = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    found = spark.createDataFrame([(1, 2, 0, "later"), (1, 1, 5, "second"), (1, 1, 2, "first"), (3, 1, 0, None)], "row_id long, phase int, seq int, reason string")
    assert [(r.row_id, r.reason) for r in fl.row_status(df, found.where("row_id = 1")).orderBy("row_id").collect()] == [(1, "first"), (2, "---"), (3, "---")]
    assert [tuple(r) for r in fl.flagged_page(df, found.where("row_id = 1"), 1).collect()] == [(1, "first")]
    assert [tuple(r) for r in fl.review_batch(df, found.where("row_id = 1"), 2).orderBy("row_id").collect()] == [(1, "first"), (2, None)]
    assert fl.flagged_page(df, found.select("row_id", "reason").where("row_id = 1"), 1).count() == 1
