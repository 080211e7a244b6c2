"""Jobs on precomputed vectors and verdicts; vectors of several lengths."""

import pytest
from pyspark.sql import functions as F

from rowaudit.operators import rules as ru
from rowaudit.operators.ensemble import ensemble
from rowaudit.operators.lof import knn
from rowaudit.plans.jobs import sanitize_text


def _docs(spark, n=60):
    return spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("a fairly good text number "), F.col("id")).alias("t"),
                                 F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("y"),
                                 F.array(F.sin("id"), F.cos("id"), F.when(F.col("id") == 7, 50.0).otherwise(0.0)).alias("v"))


def test_sanitize_text_with_vectors_and_verdicts(spark):
    rules = ru.TextRules(min_length=0, flag_urls=False, flag_gibberish=False)
    d = _docs(spark)
    plain = {r.row_id: r.reason for r in sanitize_text(d, "t", "y", rules, vec="v").collect()}
    assert plain[7] == "Semantic outlier"
    verdicts = spark.createDataFrame([(7, "keep", None), (3, "remove", "judged")], "row_id long, verdict string, reason string")
    judged = sanitize_text(d, "t", "y", rules, vec="v", verdicts=verdicts)
    assert judged.count() >= 1


def test_uneven_vectors_raise(spark):
    d = _docs(spark)
    bad = d.withColumn("v", F.when(F.col("row_id") == 5, F.array(F.lit(1.0))).otherwise(F.col("v")))
    null = d.withColumn("v", F.when(F.col("row_id") != 5, F.col("v")))
    for df in (bad, null):
        for job in (lambda x: knn(x, "v", 3), lambda x: ensemble(x, vec="v"),
                    lambda x: sanitize_text(x, "t", "y", ru.TextRules(min_length=0, flag_urls=False, flag_gibberish=False), vec="v")):
            with pytest.raises(ValueError, match="one length"):
                job(df)
