"""Phase-1 rules are stateless column expressions, so they apply unchanged
to a streaming DataFrame; frozen detectors score each micro-batch through
``foreachBatch`` (the fitted model is broadcast once per batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowaudit.operators import forest
from rowaudit.operators.flags import flags_from
from rowaudit.operators.rules import check_table, check_text


def gate_stream(stream: DataFrame, rules=None, text_col: str | None = None, text_rules=None) -> DataFrame:
    """Streaming flag rows (row_id, phase, seq, column, reason, score)."""
    if text_col is not None:
        checked = check_text(stream, text_col, text_rules, None, "_p1")
    else:
        checked = check_table(stream, rules, "_p1")
    return flags_from(checked, "_p1", 1)


def score_batches(model: forest.IsolationForestModel, threshold: float, sink_path: str):
    """foreachBatch function: score a micro-batch with a frozen forest and
    append the rows above ``threshold`` as phase-2 flags to ``sink_path``."""
    def run(batch: DataFrame, epoch: int) -> None:
        s = forest.score(batch, model, "_iso")
        out = s.where(F.col("_iso") > F.lit(threshold)).select(
            F.col("row_id").cast("long"), F.lit(2).alias("phase"), F.lit(1).alias("seq"),
            F.lit(None).cast("string").alias("column"), F.lit("IsolationForest outlier").alias("reason"),
            F.col("_iso").alias("score"), F.lit(epoch).cast("long").alias("epoch"))
        out.write.mode("append").parquet(sink_path)
    return run
