"""The filter over the trusted ids: never part of a plan's text, and null ids are never trusted."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowaudit.llm import quality


def test_filter_is_not_written_into_plans(spark):
    words = quality.id_filter(spark.range(50_000).withColumnRenamed("id", "i"), "i")
    some = spark.range(10).where(quality.in_filter(F.col("id"), words))
    assert some.count() == 10
    assert len(some._jdf.queryExecution().toString()) < 20_000


def test_null_ids_are_not_trusted_when_the_filter_marks_all(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_FILTER_BITS", 64)
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 3}") for i in range(300)] + [(None, "word1 rare")], "doc_id long, text string")
    trusted = spark.range(200).select(F.col("id").alias("doc_id"))
    marked = quality.fit_weights(docs, trusted)
    monkeypatch.undo()
    assert marked == quality.fit_weights(docs, trusted)
    without = quality.fit_weights(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))), trusted)
    assert marked == without
