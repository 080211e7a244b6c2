"""Cleaning and feature preparation as DataFrame transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.functions.lexicon import lexicon_mean
from rowaudit.functions.numeric import clean_nonfinite as _nonfinite
from rowaudit.functions.numeric import strict_double
from rowaudit.functions.text import clean_text, word_count
from rowaudit.operators import profile as pr
from rowaudit.operators.outliers import medians
from rowaudit.operators.rows import BROADCAST_ROWS
from rowaudit.operators.rules import numeric_value

# Rows per fill bucket (one task sorts at most this many rows).
FILL_BUCKET = 1_000_000
# Distinct categories allowed for one-hot columns (it widens the schema).


def coerce_median_impute(df: DataFrame, cols: list[str], zero_if_empty: bool = False) -> DataFrame:
    """Parse to double (bad -> null), then null -> column median (-> 0)."""
    vals = {c: numeric_value(df, c) for c in cols}
    med = medians(df, vals)
    out = df
    for c in cols:
        fill = med[c]
        if fill is None and zero_if_empty:
            fill = 0.0
        out = out.withColumn(c, F.coalesce(vals[c], F.lit(fill).cast("double")))
    return out


def mode_value(df: DataFrame, col: str):
    """Most frequent value, smallest on ties (None if the column is all null)."""
    r = (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
         .orderBy(F.desc("_n"), F.asc(col)).limit(1).first())
    return None if r is None else r[0]


def mode_impute(df: DataFrame, col: str, default: str = "unknown") -> DataFrame:
    m = mode_value(df, col)
    fill = default if m is None else str(m)
    return df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit(fill)))


def text_fill_empty(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit("")))


def ffill_bfill(df: DataFrame, col: str, order: str = "row_id", bucket_rows: int = FILL_BUCKET,
                parse: bool = True) -> DataFrame:
    """Forward then backward fill of ``col`` in ``order`` (a unique long).

    The rows are numbered in that order and cut into buckets of ``bucket_rows`` consecutive
    positions, so sparse or clustered ids make no difference.  The fill runs inside each
    bucket, and each bucket's last/first non-null value is carried across buckets through a
    per-bucket table.  Only order and value are moved; rows without an order value get null.
    """
    v = F.col(col)
    if parse and isinstance(df.schema[col].dataType, T.StringType):
        v = F.try_to_timestamp(v)
    d = ranked_sorted(df.select(F.col(order).alias("_o"), v.alias("_v")).where(F.col("_o").isNotNull()), "_o", "_pos")
    d = d.withColumn("_b", F.floor((F.col("_pos") - 1) / bucket_rows))
    # both fills are running frames (O(n) per bucket); the backward fill runs
    # over the reversed order instead of a shrinking 'to unbounded following' frame
    fwd = Window.partitionBy("_b").orderBy(F.col("_pos").asc()).rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy("_b").orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    per = d.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_pos"))).alias("_last"),
                              F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_pos"))).alias("_first"))
    # one row per bucket of ``bucket_rows`` rows, ordered without a partition
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    per = per.select("_b", F.last("_last", ignorenulls=True).over(before).alias("_carry_f"),
                     F.first("_first", ignorenulls=True).over(after).alias("_carry_b"))
    d = d.withColumn("_ff", F.last("_v", ignorenulls=True).over(fwd)) \
         .withColumn("_bf", F.last("_v", ignorenulls=True).over(bwd))
    small = (d.agg(F.max("_b")).first()[0] or 0) < BROADCAST_ROWS
    d = d.join(F.broadcast(per) if small else per, "_b", "left")
    d = d.select("_o", F.coalesce("_ff", "_carry_f", "_bf", "_carry_b").alias("_fill"))
    return df.join(d, F.col(order) == F.col("_o"), "left").withColumn(col, F.col("_fill")).drop("_o", "_fill")


def text_features(df: DataFrame, col: str, lexicon_rows=None) -> DataFrame:
    """<col>_raw, cleaned <col>_clean, <col>_length, <col>_word_count, <col>_sentiment."""
    t = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return (df.withColumn(f"{col}_raw", F.col(col)).withColumn(col, t)
            .withColumn(f"{col}_clean", clean_text(F.col(col)))
            .withColumn(f"{col}_length", F.length(F.col(col)))
            .withColumn(f"{col}_word_count", word_count(F.col(col)))
            .withColumn(f"{col}_sentiment", lexicon_mean(F.col(col), lexicon_rows, "polarity")))


def minmax_normalize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min)/(max - min); a constant column is left unchanged."""
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
                 *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols]).first()
    out = df
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if lo is not None and hi is not None and hi != lo:
            out = out.withColumn(c, (F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo))
    return out


def category_codes(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """0-based code of each value in sorted order of the distinct values
    (null -> -1).  Codes come from a range-partitioned rank of the distinct
    values, so high cardinality never lands in one task."""
    name = name or col
    s = F.col(col).cast("string")
    distinct = df.where(s.isNotNull()).select(s.alias("_val")).distinct()
    codes = ranked_sorted(distinct, "_val", "_code")
    n = codes.count()
    codes = F.broadcast(codes) if n <= 2_000_000 else codes
    out = df.withColumn("_val", s).join(codes, "_val", "left")
    return out.withColumn(name, F.coalesce(F.col("_code") - 1, F.lit(-1)).cast("int")).drop("_val", "_code")


def ranked_sorted(df: DataFrame, col: str, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank by ``col`` over the whole (distinct-valued) table:
    range-partition, sort inside partitions, add per-partition offsets."""
    from rowaudit.session import cut_lineage
    p = partitions or df.sparkSession.sparkContext.defaultParallelism
    srt = cut_lineage(df.repartitionByRange(p, col).sortWithinPartitions(col))
    tagged = srt.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return tagged.join(F.broadcast(offs), "_pid").withColumn(name, F.col("_off") + local + 1) \
        .drop("_pid", "_mid", "_off")


def categories(df: DataFrame, col: str) -> list[str]:
    """The distinct values as sorted text.  They become columns, so the caller asks for a schema of
    that size; see ``one_hot_rows`` for columns with many values."""
    vals = df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("v")).distinct()
    return [r[0] for r in vals.orderBy("v").collect()]


def one_hot(df: DataFrame, col: str, keep: bool = False) -> DataFrame:
    """One 0/1 column per category (sorted), none dropped; null -> all zeros."""
    s = F.col(col).cast("string")
    out = df.select("*", *[F.when(s == v, 1).otherwise(0).cast("int").alias(f"{col}_{v}") for v in categories(df, col)])
    return out if keep else out.drop(col)


def one_hot_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same as sparse rows for any number of values: (row_id, column, category, position), the
    place of the 1 among all values of the columns, in order of column, then value; a null has none."""
    long = df.select("row_id", F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("_c", "category")).where("category is not null")
    # ranked as texts that sort like (column, value)
    key = F.concat(F.format_string("%06d", "_c"), F.lit("\0"), F.col("category"))
    place = ranked_sorted(long.select(key.alias("_key")).distinct(), "_key", "_rank")
    names = F.array(*[F.lit(c) for c in cols])
    return long.withColumn("_key", key).join(place, "_key").select("row_id", F.get(names, F.col("_c")).alias("column"), "category",
                                                                   (F.col("_rank") - 1).alias("position"))


@dataclass(frozen=True)
class Scaler:
    """Mean and population sd (1 for a constant) by column; fitted on one table, applied to any."""
    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> "Scaler":
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{a}_{c}") for c in cols for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return cls({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols})

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})

    def save(self, spark, path: str) -> None:
        rows = [(c, m, s) for c, (m, s) in self.stats.items()]
        spark.createDataFrame(rows, "col string, mean double, sd double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "Scaler":
        return cls({r["col"]: (r["mean"], r["sd"]) for r in spark.read.parquet(path).collect()})


def standard_scale(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean)/population sd; sd 0 -> divide by 1."""
    return Scaler.fit(df, cols).transform(df, suffix) if cols else df


def select_features(df: DataFrame, rules, keep=("row_id",)) -> DataFrame:
    cols = [r.col_name for r in rules if r.is_feature and r.col_name in df.columns]
    return df.select(*keep, *cols)


def clean_nonfinite(df: DataFrame, cols: list[str]) -> DataFrame:
    out = df
    for c in cols:
        out = out.withColumn(c, _nonfinite(F.col(c)))
    return out


def prepare_table(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Type inference -> cleaning -> text features -> min-max -> category codes."""
    types = types or pr.infer_four_types(df)
    num = [c for c, t in types.items() if t == pr.NUMERICAL]
    cat = [c for c, t in types.items() if t == pr.CATEGORICAL]
    txt = [c for c, t in types.items() if t == pr.TEXT]
    dts = [c for c, t in types.items() if t == pr.DATETIME]
    out = coerce_median_impute(df, num) if num else df
    for c in cat:
        out = mode_impute(out, c)
    for c in txt:
        out = text_fill_empty(out, c)
    for c in dts:
        out = ffill_bfill(out, c)
    for c in txt:
        out = text_features(out, c)
    out = minmax_normalize(out, num) if num else out
    for c in cat:
        out = category_codes(out, c)
    return out


__all__ = ["coerce_median_impute", "mode_impute", "text_fill_empty", "ffill_bfill", "text_features",
           "minmax_normalize", "category_codes", "one_hot", "one_hot_rows", "Scaler", "standard_scale", "select_features",
           "clean_nonfinite", "prepare_table", "strict_double"]
