"""Phase-1 checks run unchanged on a streaming DataFrame."""

from pyspark.sql import functions as F

from rowaudit.operators import rules as ru
from rowaudit.streaming import gate_stream


def test_gate_stream_matches_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/").where(F.col("event_id").isNotNull())
    # the folder holds other tables too: keep events-shaped rows only
    rules = [ru.ColumnRule("event_type", ru.CATEGORICAL, valid_categories=["click", "view", "purchase", "signup"])]
    s = gate_stream(stream.withColumn("row_id", F.col("event_id")), rules)
    q = s.writeStream.format("memory").queryName("gate_flags").outputMode("append") \
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select count(*) from gate_flags").first()[0]
    want = batch.where(~F.col("event_type").isin("click", "view", "purchase", "signup")).count()
    assert got == want
