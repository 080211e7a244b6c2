"""Exact quantiles and one-pass column statistics.

``percentile`` (exact, linear interpolation like NumPy's default) keeps a
value->count map; it is used directly up to ``EXACT_LIMIT`` rows.  Above it,
``percentile_approx`` brackets the wanted order statistics, the rows inside
the bracket are counted, and the exact answer is read from that bounded
slice -- so no task ever holds more than ``EXACT_LIMIT`` values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT_LIMIT = 5_000_000


def _bracket(df: DataFrame, col: str, lo_r: int, hi_r: int, n: int, exact_limit: int) -> dict[int, float]:
    """Order statistics lo_r..hi_r (0-based, a few adjacent ranks) without
    sorting the column: bracket them with percentile_approx, then take the
    exact values from the (bounded) slice inside the bracket."""
    x = F.col(col)
    acc = int(min(2 ** 31 - 1, max(10_000, 8 * n // max(exact_limit, 1))))
    margin = max(2, 2 * n // acc)
    while True:
        qa = max(0.0, (lo_r - margin) / n)
        qb = min(1.0, (hi_r + 1 + margin) / n)
        a, b = df.agg(F.percentile_approx(x, F.array(F.lit(qa), F.lit(qb)), acc).alias("p")).first()["p"]
        st = df.agg(F.sum(F.when(x < a, 1).otherwise(0)).alias("below"),
                    F.sum(F.when((x >= a) & (x <= b), 1).otherwise(0)).alias("inside")).first()
        below, inside = int(st["below"] or 0), int(st["inside"] or 0)
        if below <= lo_r and below + inside > hi_r:
            break
        margin *= 2
    sl = df.where((x >= a) & (x <= b)).select(x.alias("v"))
    ranks = list(range(lo_r, hi_r + 1))
    fracs = [(r - below) / (inside - 1) if inside > 1 else 0.0 for r in ranks]
    row = sl.agg(F.percentile("v", F.array(*[F.lit(f) for f in fracs])).alias("p")).first()
    return {r: v for r, v in zip(ranks, row["p"])}


def exact_quantiles(df: DataFrame, col: str, qs: list[float],
                    exact_limit: int = EXACT_LIMIT) -> list[float | None]:
    """``numpy.percentile(x, 100*q)`` (linear) for each q, nulls ignored."""
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias(col))
    n = x.count()
    if n == 0:
        return [None for _ in qs]
    if n <= exact_limit:
        row = x.agg(F.percentile(col, F.array(*[F.lit(float(q)) for q in qs])).alias("p")).first()
        return list(row["p"])
    vals: dict[int, float] = {}
    for q in qs:
        lo = math.floor(q * (n - 1))
        vals.update(_bracket(x, col, lo, min(n - 1, lo + 1), n, exact_limit))
    out = []
    for q in qs:
        pos = q * (n - 1)
        lo = math.floor(pos)
        hi = min(n - 1, lo + 1)
        out.append(vals[lo] + (pos - lo) * (vals[hi] - vals[lo]))
    return out


def exact_quantile(df: DataFrame, col: str, q: float, exact_limit: int = EXACT_LIMIT) -> float | None:
    return exact_quantiles(df, col, [q], exact_limit)[0]


def column_quantiles(df: DataFrame, values: dict[str, Column], qs: list[float], accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """``numpy.percentile`` (linear) of any number of value columns, nulls ignored, in two jobs.

    The columns become rows (column, value).  One pass brackets every wanted order statistic
    with ``percentile_approx``; a second counts, per bracket, the rows below it and those of each
    value inside, and a running sum over these few values finds the exact ones.  A bracket holds
    about ``6 / accuracy`` of a column's rows.
    """
    names = list(values)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), values[k].cast("double").alias("v")) for i, k in enumerate(names)])).alias("x")) \
        .select("x.c", "x.v").where("v is not null")
    eps = 3.0 / accuracy
    marks = [x for q in qs for x in (max(0.0, q - eps), min(1.0, q + eps))]
    ends = long.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(*[F.lit(x) for x in marks]), F.lit(accuracy)).alias("p"))
    ends = {r["c"]: r for r in ends.collect()}  # a row per column
    out: dict[str, list[float | None]] = {k: [None] * len(qs) for k in names}
    if not ends:
        return out
    brackets = [(c, j, math.floor(q * (r["n"] - 1)), r["p"][2 * j] if q > eps else -math.inf, r["p"][2 * j + 1] if q < 1 - eps else math.inf)
                for c, r in ends.items() for j, q in enumerate(qs)]
    found: dict[tuple[int, int], dict[int, float]] = {(c, j): {} for c, j, *_ in brackets}
    while brackets:
        table = df.sparkSession.createDataFrame(brackets, "c int, j int, lo long, a double, b double")  # columns x quantiles rows
        hit = long.join(F.broadcast(table), "c").where("v <= b")
        hit = hit.groupBy("c", "j", "lo", F.when(F.col("v") >= F.col("a"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("m"))
        upto = Window.partitionBy("c", "j").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = hit.withColumn("upto", F.sum("m").over(upto)).where("upto > lo and upto - m <= lo + 1")  # the values of rank lo and lo + 1
        for r in run.collect():
            for rank in (r["lo"], r["lo"] + 1):
                if r["upto"] - r["m"] <= rank < r["upto"]:
                    found[r["c"], r["j"]][rank] = r["v"]
        again = []
        for c, j, lo, a, b in brackets:
            got, last = found[c, j], ends[c]["n"] - 1
            if got.get(lo) is None or (lo < last and got.get(lo + 1) is None):  # the bracket missed: open it
                again.append((c, j, lo, -math.inf, math.inf))
        if again == brackets:
            raise ArithmeticError("order statistics not found; are there NaN values?")
        brackets = again
    for (c, j), got in found.items():
        pos = qs[j] * (ends[c]["n"] - 1)
        lo = math.floor(pos)
        out[names[c]][j] = got[lo] + (pos - lo) * (got[lo + 1] - got[lo]) if pos > lo else got[lo]
    return out


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long table (column, n, mean, sd_pop, sd_samp, min, max, median): one pass over (column, value)
    rows for the moments, two jobs for all exact medians."""
    values = {c: F.col(c).cast("double") for c in cols}
    med = column_quantiles(df, values, [0.5])
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), values[c].alias("v")) for c in cols])).alias("x")).select("x.column", "x.v")
    m = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd_pop"),
                                   F.stddev_samp("v").alias("sd_samp"), F.min("v").alias("min"), F.max("v").alias("max"))
    table = df.sparkSession.createDataFrame([(c, med[c][0]) for c in cols], "column string, median double")
    return m.join(F.broadcast(table), "column")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per label (map-side combined, so a dominant label is cheap)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def smallest_class(df: DataFrame, label: str) -> int:
    r = class_counts(df, label).agg(F.min("n")).first()[0]
    return int(r or 0)


def vector_length(df: DataFrame, vec: str) -> int:
    """The one length of the vectors of a column; raises where they differ or one is null."""
    v = F.col(vec)
    row = df.agg(F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.count_if(v.isNull()).alias("none")).first()
    if row["none"] or row["lo"] != row["hi"]:
        raise ValueError(f"column {vec}: vectors must have one length and not be null")
    return row["lo"] or 0


def as_matrix(pdf: pd.DataFrame, cols: list[str] | str) -> np.ndarray:
    """The rows of number columns, or the vectors of one array column, as a matrix."""
    if not isinstance(cols, str):
        return pdf[cols].to_numpy(float)
    return np.stack(pdf[cols].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))


def scaled_vector(df: DataFrame, vec: str) -> Column:
    """The vectors of an array column with each place standardised: (x - mean) / population sd, sd 0 -> divide by 1."""
    long = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("at", "v"))
    rows = long.groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("at").collect()  # a row per place
    mean, sd = (F.lit([float(x) for x in xs]) for xs in ([r["m"] or 0.0 for r in rows], [r["s"] or 1.0 for r in rows]))
    return F.transform(F.col(vec).cast("array<double>"), lambda v, i: (v - F.get(mean, i)) / F.get(sd, i))
