"""End-to-end jobs: sanitize (phases 1 -> 2 -> 3), ensembles, evaluation.

Each phase runs on the rows no earlier phase flagged.  The working set is a
filter on the previous phase's finding column (no anti join), and phase
results are checkpointed into spark.checkpoint.dir so a lost executor costs
one phase, not the whole lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowaudit.operators import audit, ensemble, forest, text
from rowaudit.operators.clean import standard_scale
from rowaudit.operators.flags import (adjudicate, detection_metrics, empty_flags, finding, flags_from,
                                      metrics_from_flags)
from rowaudit.operators.outliers import impute_median_zero
from rowaudit.operators.rules import NUMERICAL, ColumnRule, TextRules, check_table, check_text
from rowaudit.operators.stats import vector_length
from rowaudit.session import cut_lineage

MIN_DETECT_ROWS = 10
MIN_AUDIT_ROWS = 20


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phase2_table(clean: DataFrame, num_features: list[str], z: float = 4.0, use_forest: bool = True,
                 n_trees: int = 200, seed: int = 42, name: str = "p2") -> DataFrame:
    """z-score on median-imputed features, then Isolation Forest on the same
    (unscaled) values; the z-score reason wins on rows both flag."""
    n = clean.count()
    imp, _ = impute_median_zero(clean, num_features, n)
    num = [f"_num_{c}" for c in num_features]
    st = imp.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(num)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(num)]).first()
    parts = []
    for i, (c, src) in enumerate(zip(num, num_features)):
        s = st[f"s{i}"] or 0.0
        zc = (F.col(c) - F.lit(st[f"m{i}"] or 0.0)) / F.lit(s if s > 0 else 1.0)
        parts.append(F.when(F.abs(zc) > z, finding(i, src, f"Z-score outlier {src}", F.abs(zc))))
    out = imp.withColumn("_p2z", F.coalesce(*parts))
    if use_forest and n > MIN_DETECT_ROWS:
        out = forest.outliers(out, num, forest.contamination_for(n), n_trees=n_trees, seed=seed, name="_p2iso")
        out = out.withColumn("_p2iso", F.when(F.col("_p2iso").isNotNull(),
                                              finding(len(num), None, "IsolationForest outlier", F.col("_p2iso.score"))))
        out = out.withColumn(name, F.coalesce("_p2z", "_p2iso")).drop("_p2z", "_p2iso")
    else:
        out = out.withColumnRenamed("_p2z", name)
    return out.drop(*num)


def sanitize_table(df: DataFrame, rules: list[ColumnRule], task: str, target: str,
                   use_forest: bool = True, seed: int = 42) -> DataFrame:
    """Flags (row_id, phase, seq, column, reason, score) for a table.

    task: 'classification' runs the label audit; 'regression' stops after
    phase 2 (its canary is never used to flag)."""
    spark = df.sparkSession
    # only what the phases read is kept between them
    needed = {"row_id", target, *(r.col_name for r in rules)}
    d = cut_lineage(check_table(df.select(*[c for c in df.columns if c in needed]), rules, "p1"))
    flags = [flags_from(d, "p1", 1)]
    clean = d.where(F.col("p1").isNull()).drop("p1")
    n_clean = clean.count()
    num = [r.col_name for r in rules if r.is_feature and r.data_type == NUMERICAL and r.col_name in df.columns]
    if n_clean >= MIN_DETECT_ROWS and num:
        c2 = cut_lineage(phase2_table(clean, num, use_forest=use_forest, seed=seed))
        flags.append(flags_from(c2, "p2", 2))
        clean = c2.where(F.col("p2").isNull()).drop("p2")
        n_clean = clean.count()
    if task == "classification" and n_clean >= MIN_AUDIT_ROWS:
        feats = [r.col_name for r in rules if r.is_feature and r.col_name in df.columns and r.col_name != target]
        types = {r.col_name: r.data_type for r in rules}
        p3 = audit.audit_table(clean, feats, types, target, seed=seed)
        if p3 is not None:
            flags.append(flags_from(p3, "p3", 3))
    return _union(flags) if flags else empty_flags(spark)


def sanitize_text(df: DataFrame, text_col: str, target: str, rules: TextRules | None = None,
                  vec: str | None = None, lexicon=None, verdicts: DataFrame | None = None,
                  contamination: float = 0.03, seed: int = 42) -> DataFrame:
    """Flags for a labelled text table; ``vec`` names a precomputed embedding
    column, otherwise hashed TF-IDF vectors are used.  Optional verdicts
    adjudicate the result (phase 4)."""
    d = cut_lineage(check_text(df, text_col, rules, lexicon, "p1"))
    flags = [flags_from(d, "p1", 1)]
    clean = d.where(F.col("p1").isNull()).drop("p1")
    n_clean = clean.count()
    if n_clean >= MIN_DETECT_ROWS:
        e = clean if vec is not None else text.embed_text(clean, text_col, name="_emb")
        vcol = vec or "_emb"
        dim = vector_length(e, vcol)
        cols = [f"_d{i}" for i in range(dim)]
        e = e.select("*", *[F.col(vcol)[i].cast("double").alias(c) for i, c in enumerate(cols)])
        e = standard_scale(e, cols)
        o = forest.outliers(e, cols, contamination, seed=seed, name="p2", reason="Semantic outlier")
        o = cut_lineage(o.drop(*cols))
        flags.append(flags_from(o, "p2", 2))
        clean = o.where(F.col("p2").isNull()).drop("p2")
        if vec is None:
            clean = clean.drop("_emb")
    p3 = audit.audit_text(clean, text_col, target)
    if p3 is not None:
        flags.append(flags_from(p3, "p3", 3))
    out = _union(flags)
    return adjudicate(out, verdicts) if verdicts is not None else out


def ensemble_detect_table(df: DataFrame, cols: list[str], truth: str = "is_actual_poisoned", **kw):
    """(scored rows, metrics) for a table with a 0/1 truth column."""
    s = ensemble.ensemble(df, cols, **kw)
    return s, detection_metrics(s, truth, "is_predicted_poisoned")


def ensemble_detect_text(df: DataFrame, text_col: str, truth: str = "is_actual_poisoned",
                         vec: str | None = None, **kw):
    if vec is None:
        df = text.embed_text(df.withColumn("_at", F.monotonically_increasing_id()), text_col, name="_emb", once=True)
        vec = "_emb"
    s = ensemble.ensemble(df, vec=vec, **kw)
    return s, detection_metrics(s, truth, "is_predicted_poisoned")


def evaluate_injected(poisoned: DataFrame, rules: list[ColumnRule], task: str, target: str, **kw) -> DataFrame:
    """Sanitize a poisoned table and score the flags against its truth column."""
    flags = sanitize_table(poisoned, rules, task, target, **kw)
    truth = poisoned.where(F.col("is_actual_poisoned") == 1).select("row_id")
    return metrics_from_flags(poisoned.select("row_id"), flags, truth)
