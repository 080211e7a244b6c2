"""The flag table and everything computed from it.

Flags are a long table ``(row_id, phase, seq, column, reason, score)``.
Inside the sanitize jobs a phase's finding is first a struct column on the
data itself (map-only); ``flags_from`` turns it into the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAG_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

NO_REASON = "---"


def finding(seq, column, reason, score=None) -> Column:
    """Struct for one finding (the element type of a phase column)."""
    return F.struct(F.lit(seq).cast("int").alias("seq"),
                    (column if isinstance(column, Column) else F.lit(column)).cast("string").alias("column"),
                    (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason"),
                    (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"))


def flags_from(df: DataFrame, finding_col: str, phase: int) -> DataFrame:
    """Long flags from a struct column produced by ``finding`` (nulls skipped)."""
    # the finding struct is evaluated once per row: the one-element explode keeps
    # the optimizer from pushing each field extraction into the (costly) checks
    one = df.select(F.col("row_id").cast("long").alias("row_id"), F.explode(F.array(F.col(finding_col))).alias("_f"))
    f = F.col("_f")
    return one.where(f.isNotNull()).select(
        "row_id", F.lit(phase).cast("int").alias("phase"),
        f["seq"].alias("seq"), f["column"].alias("column"), f["reason"].alias("reason"),
        f["score"].alias("score"))


def empty_flags(spark) -> DataFrame:
    return spark.createDataFrame([], FLAG_SCHEMA)


def merge_flags(*flags: DataFrame) -> DataFrame:
    """Union of flag tables, earliest (phase, seq) wins per row: one row per row_id."""
    u = flags[0]
    for f in flags[1:]:
        u = u.unionByName(f)
    best = F.min_by(F.struct("phase", "seq", "column", "reason", "score"), F.struct("phase", "seq"))
    return u.groupBy("row_id").agg(best.alias("f")).select("row_id", "f.*")


def drop_flagged(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows not flagged (left anti join on row_id)."""
    return df.join(flags.select("row_id"), "row_id", "left_anti")


def mark_truth(df: DataFrame, truth: DataFrame, name: str = "is_actual_poisoned") -> DataFrame:
    """0/1 column: is the row in the truth set (truth: row_id)."""
    t = truth.select("row_id").distinct().withColumn("_t", F.lit(1))
    return df.join(t, "row_id", "left").withColumn(name, F.coalesce("_t", F.lit(0)).cast("int")).drop("_t")


def first_reasons(flags: DataFrame) -> DataFrame:
    """(row_id, reason): of several findings of a row the earliest by phase and seq, where the table has them."""
    order = [c for c in ("phase", "seq") if c in flags.columns]
    return flags.groupBy("row_id").agg(F.min_by("reason", F.struct(*order, "reason")).alias("reason"))


def row_status(df: DataFrame, flags: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Every row with is_flagged, reason ('---' if none), is_actual_poisoned and
    status tp/fp/fn/clean (clean also when no truth is given)."""
    fl = first_reasons(flags).withColumnRenamed("reason", "_reason")
    out = df.join(fl, "row_id", "left")
    out = out.withColumn("is_flagged", F.col("_reason").isNotNull()) \
        .withColumn("reason", F.coalesce("_reason", F.lit(NO_REASON))).drop("_reason")
    if truth is None:
        return out.withColumn("is_actual_poisoned", F.lit(None).cast("boolean")).withColumn("status", F.lit("clean"))
    out = mark_truth(out, truth, "_truth")
    t = F.col("_truth") == 1
    status = (F.when(F.col("is_flagged") & t, "tp").when(F.col("is_flagged") & ~t, "fp")
              .when(~F.col("is_flagged") & t, "fn").otherwise("clean"))
    return out.withColumn("is_actual_poisoned", t).withColumn("status", status).drop("_truth")


def adjudicate(flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Apply a verdict table ``(row_id, verdict, reason)`` to first-wins flags.

    verdict 'remove' drops the flag, 'flag' sets/overrides it with the
    verdict's reason, 'keep' (or no verdict) leaves the flag as it is.
    """
    v = verdicts.select("row_id", F.lower("verdict").alias("_v"), F.col("reason").alias("_vr"))
    j = flags.join(v, "row_id", "full_outer")
    added = F.col("_v") == "flag"
    out = j.where(~F.coalesce(F.col("_v") == "remove", F.lit(False))) \
        .where(F.col("reason").isNotNull() | added)
    return out.select(
        "row_id",
        F.when(added, F.lit(4)).otherwise(F.col("phase")).cast("int").alias("phase"),
        F.when(added, F.lit(0)).otherwise(F.col("seq")).cast("int").alias("seq"),
        F.when(added, F.lit(None).cast("string")).otherwise(F.col("column")).alias("column"),
        F.when(added, F.concat(F.lit("Judge: "), F.col("_vr"))).otherwise(F.col("reason")).alias("reason"),
        F.when(added, F.lit(None).cast("double")).otherwise(F.col("score")).alias("score"))


def apply_decisions(df: DataFrame, flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Export set after review: unflagged rows plus flagged rows the reviewer
    chose to keep (decisions: row_id, decision 'keep'/'remove'; default remove)."""
    d = decisions.select("row_id", F.lower("decision").alias("_d"))
    fl = flags.select("row_id").distinct().join(d, "row_id", "left") \
        .where(F.coalesce(F.col("_d"), F.lit("remove")) != "keep").select("row_id")
    return df.join(fl, "row_id", "left_anti")


def phase_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("phase").agg(F.count(F.lit(1)).alias("n_flagged"))


def findings_report(flags: DataFrame, df: DataFrame) -> DataFrame:
    """(phase, reason, n_flagged, pct_of_rows) with the total row count broadcast."""
    total = df.count()
    g = flags.groupBy("phase", "reason").agg(F.count(F.lit(1)).alias("n_flagged"))
    return g.select("phase", "reason", "n_flagged",
                    F.round(F.col("n_flagged") * 100.0 / F.lit(max(total, 1)), 6).alias("pct_of_rows"))


def basic_metrics(df: DataFrame, flags: DataFrame) -> DataFrame:
    # one pass: every row with a 0/1 "is flagged" mark from a left join
    marked = df.select("row_id").join(flags.select("row_id").distinct().withColumn("_f", F.lit(1)), "row_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("total_rows"),
                      F.count("_f").alias("flagged_rows"))


def detection_metrics(df: DataFrame, truth_col: str = "is_actual_poisoned",
                      pred_col: str = "is_predicted_poisoned") -> DataFrame:
    """total, poisoned_true/pred, tp/tn/fp/fn and accuracy/precision/recall/f1
    (4 decimals, 0 on an empty denominator) in one aggregation pass."""
    t = F.col(truth_col).cast("int") == 1
    p = F.col(pred_col).cast("int") == 1

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    c = df.agg(F.count(F.lit(1)).cast("long").alias("total"), cnt(t).alias("poisoned_true"),
               cnt(p).alias("poisoned_pred"), cnt(t & p).alias("tp"), cnt(~t & ~p).alias("tn"),
               cnt(~t & p).alias("fp"), cnt(t & ~p).alias("fn"))
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    c = c.withColumn("_p", prec).withColumn("_r", rec)
    f1 = F.coalesce(2 * F.col("_p") * F.col("_r") / F.nullif(F.col("_p") + F.col("_r"), F.lit(0.0)), F.lit(0.0))
    acc = F.coalesce((F.col("tp") + F.col("tn")) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return c.select("total", "poisoned_true", "poisoned_pred",
                    F.round(acc, 4).alias("accuracy"), F.round("_p", 4).alias("precision"),
                    F.round("_r", 4).alias("recall"), F.round(f1, 4).alias("f1"),
                    "tp", "tn", "fp", "fn")


def metrics_from_flags(df: DataFrame, flags: DataFrame, truth: DataFrame) -> DataFrame:
    """Detection metrics of a flag table against a truth set over all rows of df."""
    s = row_status(df.select("row_id"), flags, truth)
    return detection_metrics(s.withColumn("_t", F.col("is_actual_poisoned").cast("int"))
                             .withColumn("_p", F.col("is_flagged").cast("int")), "_t", "_p")


def flagged_page(df: DataFrame, flags: DataFrame, page: int, page_size: int = 10) -> DataFrame:
    """Page ``page`` (1-based) of flagged rows in row order."""
    j = df.join(first_reasons(flags), "row_id")
    return j.orderBy("row_id").offset((page - 1) * page_size).limit(page_size)


def first_rows(df: DataFrame, cond: Column | None = None, n: int = 50) -> DataFrame:
    """First ``n`` rows (in row order) that satisfy ``cond`` -- a top-n report."""
    d = df if cond is None else df.where(cond)
    return d.orderBy("row_id").limit(n)


def review_batch(df: DataFrame, flags: DataFrame, n: int = 200) -> DataFrame:
    """First ``n`` rows with their current flag reason (null if unflagged)."""
    head = df.orderBy("row_id").limit(n)
    return head.join(first_reasons(flags), "row_id", "left")
