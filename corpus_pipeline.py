"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``.  All stages but the last return the columns
of ``docs`` in their order; columns outside ``CORE`` are carried along untouched, whatever
their names.  The first three stages only remove rows.  The fourth repeats a document once
per epoch and cuts one document per source where its budget ends; the fifth adds ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowaudit.llm import decontam, kdshard, mixing, quality, simhash
from rowaudit.llm.common import shielded, table
from rowaudit.session import shared_dir

CORE = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, restore = shielded(docs, CORE)
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    weights = quality.fit_weights(docs.select("doc_id", "text"), trusted)
    return restore(quality.keep(docs, weights))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, restore = shielded(docs, CORE)
    return restore(simhash.keep_one(docs, shingle=3, max_bits=2))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, restore = shielded(docs, CORE)
    return restore(mixing.write_mix(mixing.plan_mix(docs)))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kdshard.shard_documents(docs, shards=SHARDS)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination),
          ("source mix", source_mix), ("sharding", sharding)]

#: DuckDB has no XXH64 fingerprints; the tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
