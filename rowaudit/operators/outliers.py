"""Statistical outliers: z-score, IQR fences, rare categories.

Each detector computes a one-row statistics table (an aggregate), reads the
few numbers back as literals, and flags with a map-only projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowaudit.operators.flags import finding
from rowaudit.operators.rules import numeric_value
from rowaudit.operators.stats import EXACT_LIMIT, column_quantiles


def medians(df: DataFrame, values: dict[str, Column], n: int | None = None) -> dict[str, float | None]:
    """Exact median of each value column; one aggregate for few values, two jobs for many."""
    n = df.count() if n is None else n
    if n * len(values) <= EXACT_LIMIT:
        row = df.agg(*[F.percentile(v, 0.5).alias(k) for k, v in values.items()]).first()
        return {k: row[k] for k in values}
    return {k: v[0] for k, v in column_quantiles(df, values, [0.5]).items()}


def impute_median_zero(df: DataFrame, cols: list[str], n: int | None = None) -> tuple[DataFrame, dict]:
    """Numeric value of each column, null -> column median -> 0 (all-null column)."""
    vals = {c: numeric_value(df, c) for c in cols}
    med = medians(df, vals, n)
    out = df
    for c in cols:
        fill = med[c] if med[c] is not None else 0.0
        out = out.withColumn(f"_num_{c}", F.coalesce(vals[c], F.lit(float(fill))))
    return out, med


def zscore(df: DataFrame, cols: list[str], z: float = 4.0, name: str = "p2z", seq0: int = 0) -> DataFrame:
    """Flag |population z| > z on median-imputed values; the first column in
    order that exceeds names the reason.  sd = 0 divides by 1."""
    imp, _ = impute_median_zero(df, cols)
    aggs = []
    for c in cols:
        x = F.col(f"_num_{c}")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    st = imp.agg(*aggs).first()
    parts = []
    for i, c in enumerate(cols):
        m = st[f"m_{c}"] or 0.0
        s = st[f"s_{c}"] or 0.0
        s = s if s > 0 else 1.0
        zc = (F.col(f"_num_{c}") - F.lit(m)) / F.lit(s)
        parts.append(F.when(F.abs(zc) > z, finding(seq0 + i, c, f"Z-score outlier {c}", F.abs(zc))))
    out = imp.withColumn(name, F.coalesce(*parts))
    return out.drop(*[f"_num_{c}" for c in cols])


def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5, name: str = "p2iqr") -> DataFrame:
    """Flag values outside [Q1 - k*IQR, Q3 + k*IQR] (exact linear quartiles)."""
    parts, values = [], {c: numeric_value(df, c) for c in cols}
    quartiles = column_quantiles(df, values, [0.25, 0.75])
    for i, c in enumerate(cols):
        v, (q1, q3) = values[c], quartiles[c]
        if q1 is None:
            continue
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        parts.append(F.when(v.isNotNull() & ~F.isnan(v) & ((v < F.lit(lo)) | (v > F.lit(hi))),
                            finding(i, c, f"IQR outlier {c}", v)))
    if not parts:
        return df.withColumn(name, F.lit(None).cast("struct<seq:int,column:string,reason:string,score:double>"))
    return df.withColumn(name, F.coalesce(*parts))


def rare_categories(df: DataFrame, col: str, share: float = 0.01, name: str = "p2rare") -> DataFrame:
    """Flag rows whose category holds less than ``share`` of the non-null rows.

    Category counts are an aggregate (map-side combined); only the rare ones
    are joined back, and they are broadcast only when their number is small.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    total = df.where(F.col(col).isNotNull()).count()
    rare = counts.where(F.col("_cnt") < F.lit(share * total)) \
        .withColumn("_share", F.col("_cnt") / F.lit(float(max(total, 1))))
    n_rare = rare.count()
    rare = F.broadcast(rare) if n_rare <= 1_000_000 else rare
    out = df.join(rare, col, "left")
    f = F.when(F.col("_cnt").isNotNull(), finding(0, col, f"Rare category {col}", F.col("_share")))
    return out.withColumn(name, f).drop("_cnt", "_share")
