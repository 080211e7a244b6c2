"""Poison injection with known ground truth.

Rows are picked by a global seeded-hash rank (never an unbounded top-n):
ranks 1..m, m+1..2m, 2m+1..3m become the three poison phases, disjoint by
construction.  Statistics the injectors need (sample sd, minimum) are one-row
aggregates; every modification is a map-only ``when``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.functions.hashing import seeded_key, unit_uniform
from rowaudit.functions.numeric import strict_double
from rowaudit.operators.clean import ranked_sorted
from rowaudit.operators.rows import global_rank
from rowaudit.session import cut_lineage

# Fixed values used by the injectors.
TYPE_ERROR = "TYPE_ERROR"
REGRESSION_TARGET_ERROR = -99999.0
SHORT_TEXT = "short"
LINK_TEXT = "Check http://malicious-link.xyz"
SPAM_SUFFIX = " buy crypto now free profit!!!"
ENSEMBLE_SPAM_SUFFIX = " spam inject poison fake review"


def phase_size(n: int, p: float) -> int:
    """Rows per poison phase: max(1, floor(n*p) // 3); 0 when floor(n*p) == 0."""
    n_poison = int(math.floor(n * p))
    return 0 if n_poison == 0 else max(1, n_poison // 3)


def pick_poison_rows(df: DataFrame, p: float = 0.05, seed: int = 42, phases: int = 3,
                     n: int | None = None) -> tuple[DataFrame, int]:
    """Add ``poison_phase`` (1..phases or null) and ``poison_pos`` (0-based
    position inside the phase) from the global md5(seed:pick:row_id) rank."""
    n = df.count() if n is None else n
    m = phase_size(n, p)
    keyed = df.withColumn("_pk", seeded_key(seed, F.lit("pick"), "row_id"))
    ranked = global_rank(keyed, "_pk", name="_pr", n=n)
    lim = m * phases
    ph = F.when(F.col("_pr") <= lim, F.ceil(F.col("_pr") / F.lit(max(m, 1)))).cast("int")
    pos = F.when(F.col("_pr") <= lim, (F.col("_pr") - 1) % F.lit(max(m, 1))).cast("long")
    out = ranked.withColumn("poison_phase", ph).withColumn("poison_pos", pos).drop("_pk", "_pr")
    # the injectors run several aggregates over this table: compute the ranks once
    return cut_lineage(out), m


def numeric_features(df: DataFrame, features: list[str], target: str | None, exclude_target: bool) -> list[str]:
    num = [c for c in features if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)]
    if not num:
        num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
               and f.name not in ("row_id",) and not (exclude_target and f.name == target)]
    if not num:
        raise ValueError("the table has no numeric column to poison")
    return num


def _type_error_then_outlier(d: DataFrame, f0: str, sd_mult: float, fallback: float) -> DataFrame:
    """Phase 1: f0 := TYPE_ERROR.  Phase 2: f0 + sd_mult * sample sd of the
    values still numeric after phase 1 (fallback if unusable)."""
    txt = F.col(f0).cast("string")
    d = d.withColumn(f0, F.when(F.col("poison_phase") == 1, F.lit(TYPE_ERROR)).otherwise(txt))
    v = strict_double(F.col(f0))
    sd = d.agg(F.stddev_samp(v).alias("sd")).first()["sd"]
    ok_sd = sd is not None and not math.isnan(sd) and sd > 0
    bumped = (v + F.lit(sd_mult * sd)) if ok_sd else F.lit(None).cast("double")
    new = F.coalesce(bumped, F.lit(float(fallback)))
    return d.withColumn(f0, F.when(F.col("poison_phase") == 2, new.cast("string")).otherwise(F.col(f0)))


def _label_ranks(df: DataFrame, label: str) -> DataFrame:
    """(_lab, _li): the distinct labels, numbered from 1 in sorted order."""
    return ranked_sorted(df.select(F.col(label).alias("_lab")).where(F.col("_lab").isNotNull()).distinct(), "_lab", "_li")


def _flip_labels(d: DataFrame, label: str, ranks: DataFrame, seed: int) -> DataFrame:
    """Phase 3: another label, drawn by the row's hash.  Joined by value and by number, so any
    number of labels will do; null labels, and a single label, stay."""
    k = ranks.count()
    if k < 2:
        return d
    h = F.conv(F.substring(seeded_key(seed, F.lit("flip"), "row_id"), 1, 8), 16, 10).cast("long")
    j = F.pmod(h, F.lit(k - 1)) + 1
    own = ranks.select(F.col("_lab").alias("_own"), F.col("_li"))
    new = ranks.select(F.col("_lab").alias("_new"), F.col("_li").alias("_ni"))
    out = d.join(own, (F.col("poison_phase") == 3) & (F.col(label) == F.col("_own")), "left")
    out = out.withColumn("_pick", j + (j >= F.col("_li")).cast("int")).join(new, F.col("_pick") == F.col("_ni"), "left")
    return out.withColumn(label, F.coalesce(F.col("_new"), F.col(label))).drop("_own", "_li", "_new", "_ni", "_pick")


def _finalize(d: DataFrame, seed: int) -> DataFrame:
    """Seeded shuffle: row_id := new position; orig_id and truth carried."""
    keyed = d.withColumn("_sk", seeded_key(seed, F.lit("shuffle"), "row_id"))
    ranked = global_rank(keyed, "_sk", name="_sr")
    return (ranked.withColumn("orig_id", F.col("row_id")).withColumn("row_id", F.col("_sr") - 1)
            .withColumn("is_actual_poisoned", F.col("poison_phase").isNotNull().cast("int"))
            .drop("_sk", "_sr", "poison_pos"))


def poison_regression(df: DataFrame, target: str, features: list[str], p: float = 0.05, seed: int = 42,
                      shuffle: bool = True) -> DataFrame:
    """Type error (+ target -99999), +20 sd outlier, feature := column minimum."""
    f0 = numeric_features(df, features, target, True)[0]
    d, m = pick_poison_rows(df, p, seed)
    d = d.withColumn(target, F.when(F.col("poison_phase") == 1, F.lit(REGRESSION_TARGET_ERROR))
                     .otherwise(F.col(target).cast("double")))
    d = _type_error_then_outlier(d, f0, 20.0, 20000.0)
    mn = d.agg(F.min(strict_double(F.col(f0))).alias("mn")).first()["mn"]
    d = d.withColumn(f0, F.when(F.col("poison_phase") == 3, F.lit(mn).cast("double").cast("string")).otherwise(F.col(f0)))
    return _finalize(d, seed) if shuffle else d


def poison_classification(df: DataFrame, target: str, features: list[str], p: float = 0.05, seed: int = 42,
                          shuffle: bool = True) -> DataFrame:
    """Type error, +10 sd outlier (fallback 1000), label flip."""
    f0 = numeric_features(df, features, target, False)[0]
    d, m = pick_poison_rows(df, p, seed)
    ranks = _label_ranks(df, target)
    d = _type_error_then_outlier(d, f0, 10.0, 1000.0)
    d = _flip_labels(d, target, ranks, seed)
    return _finalize(d, seed) if shuffle else d


def poison_text(df: DataFrame, text: str, target: str, p: float = 0.05, seed: int = 42,
                shuffle: bool = True) -> DataFrame:
    """Malformed text (alternating short / bad link), spam suffix, label flip."""
    d, m = pick_poison_rows(df, p, seed)
    ranks = _label_ranks(df, target)
    t = F.col(text).cast("string")
    malformed = F.when(F.col("poison_pos") % 2 == 0, F.lit(SHORT_TEXT)).otherwise(F.lit(LINK_TEXT))
    d = d.withColumn(text, F.when(F.col("poison_phase") == 1, malformed)
                     .when(F.col("poison_phase") == 2, F.concat(F.coalesce(t, F.lit("None")), F.lit(SPAM_SUFFIX)))
                     .otherwise(t))
    d = _flip_labels(d, target, ranks, seed)
    return _finalize(d, seed) if shuffle else d


def inject_shift(df: DataFrame, col: str, p: float = 0.05, shift: float = 10.0, seed: int = 42) -> DataFrame:
    """col += shift on floor(p*n) hash-picked rows; is_actual_poisoned marks them."""
    n = df.count()
    k = int(math.floor(p * n))
    keyed = df.withColumn("_pk", seeded_key(seed, F.lit("shift"), "row_id"))
    r = global_rank(keyed, "_pk", name="_pr", n=n)
    hit = F.col("_pr") <= k
    return r.withColumn(col, F.when(hit, F.col(col) + F.lit(shift)).otherwise(F.col(col))) \
        .withColumn("is_actual_poisoned", hit.cast("int")).drop("_pk", "_pr")


def inject_suffix(df: DataFrame, text: str, p: float = 0.05, suffix: str = ENSEMBLE_SPAM_SUFFIX,
                  seed: int = 42) -> DataFrame:
    """Append a spam phrase on floor(p*n) hash-picked rows."""
    n = df.count()
    k = int(math.floor(p * n))
    keyed = df.withColumn("_pk", seeded_key(seed, F.lit("spam"), "row_id"))
    # the texts stay where they are: keys alone are ranked, and the last one picked is the limit
    ranks = global_rank(keyed.select("row_id", "_pk"), "_pk", name="_pr", n=n)
    ends = {r["_pr"]: (r["_pk"], r["row_id"]) for r in ranks.where(F.col("_pr").isin(1, k, k + 1)).collect()}
    last = ends.get(k)
    if k == 0:
        r, hit = keyed.withColumn("_pr", F.lit(0)), F.lit(False)
    elif ends[1][1] is not None and last != ends.get(k + 1):
        r = keyed.withColumn("_pr", F.lit(0))
        hit = (F.col("_pk") < last[0]) | ((F.col("_pk") == last[0]) & (F.col("row_id") <= last[1]))
    else:  # a null id, or an id whose rows are picked in part
        r = global_rank(keyed, "_pk", name="_pr", n=n)
        hit = F.col("_pr") <= k
    return r.withColumn(text, F.when(hit, F.concat(F.col(text), F.lit(suffix))).otherwise(F.col(text))) \
        .withColumn("is_actual_poisoned", hit.cast("int")).drop("_pk", "_pr")


def gaussian_features(base: DataFrame, names=("feature1", "feature2", "feature3"), seed: int = 42) -> DataFrame:
    """Seeded standard-normal features for every row of ``base`` (Box-Muller
    on md5-derived uniforms: reproducible under any partitioning)."""
    out = base.select("row_id")
    for nm in names:
        u1 = unit_uniform(seed, F.lit(f"{nm}:a"), "row_id")
        u2 = unit_uniform(seed, F.lit(f"{nm}:b"), "row_id")
        out = out.withColumn(nm, F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2))
    return out


def linear_target(df: DataFrame, cols: list[str], coefs: list[float], noise: float = 10.0, seed: int = 42,
                  name: str = "target") -> DataFrame:
    """target = sum(coef * x) + noise * N(0,1) (the simple regression set)."""
    u1 = unit_uniform(seed, F.lit("noise:a"), "row_id")
    u2 = unit_uniform(seed, F.lit("noise:b"), "row_id")
    eps = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
    expr = F.lit(0.0)
    for c, w in zip(cols, coefs):
        expr = expr + F.lit(float(w)) * F.col(c)
    return df.withColumn(name, expr + F.lit(float(noise)) * eps)
