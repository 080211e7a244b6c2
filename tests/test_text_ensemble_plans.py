"""What the driver plans for the text ensemble does not grow with the length of the vectors."""

from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from rowaudit.plans.jobs import ensemble_detect_text


def test_no_plan_has_a_column_per_place_of_the_vector(spark, monkeypatch):
    texts = spark.range(90).select(F.col("id").alias("row_id"), F.concat(F.lit("word"), F.col("id") % 30, F.lit(" and text")).alias("text"),
                                   (F.col("id") < 5).cast("int").alias("is_actual_poisoned"))
    widths = []
    for kind, name in ((type(texts), "select"), (type(texts), "withColumns"), (GroupedData, "agg")):
        def counted(self, *args, real=getattr(kind, name)):
            out = real(self, *args)
            widths.append(len(out.columns))
            return out

        monkeypatch.setattr(kind, name, counted)
    scored, metrics = ensemble_detect_text(texts, "text", n_trees=20)  # vectors of 256 places
    found = metrics.first()
    assert widths and max(widths) < 32
    assert scored.count() == found["total"] == 90 and found["tp"] + found["fn"] == 5
    assert found["tp"] + found["fp"] + found["fn"] + found["tn"] == 90
