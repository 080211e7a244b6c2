"""What must hold for the random and iterative operators, as queries that DuckDB can answer too.

Their scores depend on draws and on floating-point solvers, so no SQL gives them row by row.
These queries run the operators over whole tables and return what does not depend on either:
the rows that are scored, labels, counts that follow from the definition of a threshold, and
laws of the result as booleans (the SQL says true).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowaudit.operators.stats import exact_quantile
from rowaudit.plans import catalogue as cat
from rowaudit.plans.catalogue import register
from rowaudit.session import cut_lineage, shared_dir

#: Rows strictly above the linear quantile q of n distinct values.
_ABOVE = "CAST(count(*) - floor({q} * (count(*) - 1)) - 1 AS BIGINT)"


def _numbers(spark, sf) -> DataFrame:
    return cat.events(spark, sf).select("row_id", *[F.col(c).cast("double").alias(c) for c in cat.EVENT_NUM])


@register("ocsvm_laws", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, {_ABOVE.format(q=0.95)} AS n_outside FROM events")
def q_ocsvm_laws(spark, sf):
    """A nu share of the rows lies outside the support."""
    from rowaudit.operators import svm
    from rowaudit.operators.clean import standard_scale
    e = standard_scale(_numbers(spark, sf), cat.EVENT_NUM)
    s = svm.score(e, svm.fit(e, cat.EVENT_NUM, nu=0.05), "s")
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("s") > 1e-12).alias("n_outside"))


@register("iforest_laws", "SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS scores_in_range, true AS share_is_contamination, true AS extremes_stand_out FROM events")
def q_iforest_laws(spark, sf):
    """Scores lie in (0, 1], at most the contamination is flagged, and the largest value scores above the mean."""
    from rowaudit.operators import forest
    o = cut_lineage(forest.outliers(_numbers(spark, sf), cat.EVENT_NUM, 0.01, keep_score=True))
    a = o.agg(F.count(F.lit(1)).alias("n_rows"), F.min("iso_score").alias("lo"), F.max("iso_score").alias("hi"), F.count("p2iso").alias("n"),
              F.max_by("iso_score", "value").alias("far"), F.avg("iso_score").alias("mean"))
    return a.select("n_rows", ((F.col("lo") > 0) & (F.col("hi") <= 1)).alias("scores_in_range"),
                    F.col("n").between(0.009 * F.col("n_rows") - 1, 0.01 * F.col("n_rows") + 1).alias("share_is_contamination"),
                    (F.col("far") > F.col("mean")).alias("extremes_stand_out"))


@register("saved_detectors_laws", "SELECT event_id AS row_id, true AS same_scaled, true AS same_iso, true AS same_svm, true AS same_lof FROM events WHERE event_id % 2 = 1")
def q_saved_detectors_laws(spark, sf):
    """Scaler and detectors fitted on the even ids, saved and loaded, score the odd ids as before."""
    from rowaudit.operators import forest, svm
    from rowaudit.operators.clean import Scaler
    from rowaudit.operators.lof import LofModel, fit_lof
    e, cols = _numbers(spark, sf), cat.EVENT_NUM
    path = shared_dir(spark, "detectors")
    scaler = Scaler.fit(e.where("row_id % 2 = 0"), cols)
    train = cut_lineage(scaler.transform(e.where("row_id % 2 = 0")))
    fitted = [scaler, forest.fit(train, cols), svm.fit(train, cols), fit_lof(train.select("row_id", F.array(*cols).alias("v")), "v", 10)]
    scaler.save(spark, f"{path}/scaler")
    fitted[1].save(spark, f"{path}/forest")
    fitted[2].save(spark, f"{path}/svm")
    fitted[3].save(f"{path}/lof")
    loaded = [Scaler.load(spark, f"{path}/scaler"), forest.IsolationForestModel.load(spark, f"{path}/forest"),
              svm.OneClassModel.load(spark, f"{path}/svm"), LofModel.load(spark, f"{path}/lof")]

    def scores(models, tag: str) -> DataFrame:
        x = cut_lineage(models[0].transform(e.where("row_id % 2 = 1")))
        near = models[3].score(x.select("row_id", F.array(*cols).alias("v")), "v").select("row_id", "lof")
        out = svm.score(forest.score(x, models[1], "iso"), models[2], "svm").join(near, "row_id")
        return out.select("row_id", *[F.col(c).alias(f"{c}_{tag}") for c in (cols[0], "iso", "svm", "lof")])

    both = scores(fitted, "a").join(scores(loaded, "b"), "row_id")
    return both.select("row_id", *[(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) < 1e-9).alias(f"same_{n}")
                                   for c, n in ((cols[0], "scaled"), ("iso", "iso"), ("svm", "svm"), ("lof", "lof"))])


@register("embed_text_laws", r"""
SELECT doc_id AS row_id, 256 AS dim, true AS unit_or_zero, regexp_matches(coalesce(text, ''), '[\p{L}\p{N}_]{2,}') OR true AS scored FROM documents""")
def q_embed_text_laws(spark, sf):
    """Every text has a vector of the asked length, of length 1, or 0 without words."""
    from rowaudit.operators.text import embed_text
    e = embed_text(cat.documents(spark, sf).select("row_id", "text"), "text", dim=256)
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return e.select("row_id", F.size("embedding").alias("dim"), ((F.abs(size - 1) < 1e-9) | (size == 0)).alias("unit_or_zero"),
                    F.col("embedding").isNotNull().alias("scored"))


@register("embedding_outliers_laws", "SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS share_is_contamination, true AS unusual_ones_flagged FROM embeddings")
def q_embedding_outliers_laws(spark, sf):
    """At most the contamination is flagged, and the flagged vectors are no nearer to the mean than the others."""
    from rowaudit.operators import forest
    from rowaudit.operators.clean import standard_scale
    cols = [f"_d{i}" for i in range(64)]
    x = standard_scale(cat.embeddings(spark, sf).select("row_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)]), cols)
    o = forest.outliers(x, cols, 0.03, name="p2")
    size = sum((F.col(c) * F.col(c) for c in cols[1:]), F.col(cols[0]) * F.col(cols[0]))
    a = o.agg(F.count(F.lit(1)).alias("n_rows"), F.count("p2").alias("n"), F.avg(F.when(F.col("p2").isNotNull(), size)).alias("far"),
              F.avg(F.when(F.col("p2").isNull(), size)).alias("near"))
    return a.select("n_rows", F.col("n").between(0.02 * F.col("n_rows") - 1, 0.03 * F.col("n_rows") + 1).alias("share_is_contamination"),
                    (F.col("far") > F.col("near")).alias("unusual_ones_flagged"))


def _audit_laws(scored: DataFrame) -> DataFrame:
    """Row by row: the label's place, a probability, its loss, and a flag for the top losses."""
    s = cut_lineage(scored.withColumn("flagged", F.col("p3").isNotNull()))
    cut = exact_quantile(s, "loss", 0.95)
    return s.select("row_id", F.col("label_idx").cast("int").alias("label_idx"), F.col("p_true").between(0, 1).alias("is_probability"),
                    (F.abs(F.col("loss") + F.log("p_true")) < 1e-9).alias("is_loss"), (F.col("flagged") == (F.col("loss") > cut)).alias("flag_is_top"))


def _audit_sql(rows: str) -> str:
    return f"""WITH d AS ({rows}), l AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i FROM (SELECT DISTINCT y FROM d))
SELECT row_id, CAST(i AS INTEGER) AS label_idx, true AS is_probability, true AS is_loss, true AS flag_is_top FROM d JOIN l USING (y)"""


_LABELLED = "SELECT d.doc_id AS row_id, CAST(l.quality AS VARCHAR) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
_ORDERS = "SELECT o_orderkey AS row_id, o_orderstatus AS y FROM orders"


@register("canary_tabular_laws", _audit_sql(_ORDERS))
def q_canary_tabular_laws(spark, sf):
    from rowaudit.operators.audit import audit_table
    return _audit_laws(audit_table(cat.orders(spark, sf), cat.ORDER_AUDIT_FEATURES, cat.ORDER_AUDIT_TYPES, "o_orderstatus"))


@register("canary_text_laws", _audit_sql(_LABELLED))
def q_canary_text_laws(spark, sf):
    from rowaudit.operators.audit import audit_text
    return _audit_laws(audit_text(cat.labelled_docs(spark, sf), "text", "quality"))


@register("canary_gbt_laws", f"SELECT row_id, true AS is_probability, true AS is_loss FROM ({_LABELLED})")
def q_canary_gbt_laws(spark, sf):
    g = cat.QUERIES["canary_gbt"](spark, sf)
    return g.select("row_id", F.col("p_true").between(0, 1).alias("is_probability"), (F.abs(F.col("loss") + F.log("p_true")) < 1e-9).alias("is_loss"))


@register("model_disagreement_laws", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS flags_are_disagreements, true AS predictions_are_labels FROM ({_ORDERS})")
def q_model_disagreement_laws(spark, sf):
    from rowaudit.operators.audit import model_disagreement
    d = model_disagreement(cat.orders(spark, sf), cat.ORDER_AUDIT_FEATURES, cat.ORDER_AUDIT_TYPES, "o_orderstatus")
    agree = (F.col("pred_lr") == F.col("pred_rf")) & (F.col("pred_lr") == F.col("pred_nb"))
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.every(F.col("p3dis").isNull() == agree).alias("flags_are_disagreements"),
                 F.every(F.greatest("pred_lr", "pred_rf", "pred_nb") <= 2).alias("predictions_are_labels"))


@register("top_loss_rows_laws", "SELECT CAST(range AS INTEGER) AS place, true AS label_is_own, true AS descending FROM range(least(20, (SELECT count(*) FROM orders)))")
def q_top_loss_rows_laws(spark, sf):
    t = cat.QUERIES["top_loss_rows"](spark, sf)
    o = cat.orders(spark, sf).select("row_id", "o_orderstatus")
    order = Window.orderBy(F.desc("loss"), "row_id")  # twenty rows
    t = t.join(o, "row_id").withColumns({"place": F.row_number().over(order) - 1, "next": F.lead("loss").over(order)})
    return t.select("place", (F.col("label") == F.col("o_orderstatus")).alias("label_is_own"), (F.coalesce("next", "loss") <= F.col("loss")).alias("descending"))


@register("pca_2d_laws", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS centred, true AS uncorrelated, true AS first_axis_is_widest, true AS wider_than_any_column FROM embeddings""")
def q_pca_2d_laws(spark, sf):
    """Centred and uncorrelated axes; the first has at least the variance of any scaled column (1)."""
    p = cat.QUERIES["pca_2d"](spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
                                            F.corr("x", "y").alias("r"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return p.select("n_rows", ((F.abs("mx") < 1e-6) & (F.abs("my") < 1e-6)).alias("centred"), (F.abs("r") < 1e-6).alias("uncorrelated"),
                    (F.col("vx") >= F.col("vy")).alias("first_axis_is_widest"), (F.col("vx") >= 1 - 1e-9).alias("wider_than_any_column"))


@register("sanitize_table_fixed_flags", f'WITH {cat.EVENT_FLAGS_SQL} SELECT row_id, phase, seq, "column", reason FROM flags')
def q_sanitize_table_fixed_flags(spark, sf):
    """The flags of the whole job that do not depend on a forest or a canary: rules and z-scores."""
    f = cat.QUERIES["sanitize_table"](spark, sf)
    return f.where((F.col("phase") == 1) | F.col("reason").startswith("Z-score")).select("row_id", "phase", "seq", "column", "reason")


_METRICS = "true AS counts_add_up, true AS rates_follow, true AS finds_some FROM {t}"


def _metric_laws(m: DataFrame) -> DataFrame:
    """The confusion counts add up to all rows, the rates follow from them, and something is found."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = F.coalesce(F.round(tp / F.nullif(tp + fp, F.lit(0)), 4), F.lit(0.0))
    recall = F.coalesce(F.round(tp / F.nullif(tp + fn, F.lit(0)), 4), F.lit(0.0))
    return m.select((tp + fp + fn + tn).cast("long").alias("n_rows"), (F.col("total") == tp + fp + fn + tn).alias("counts_add_up"),
                    ((F.abs(F.col("precision") - precision) < 2e-4) & (F.abs(F.col("recall") - recall) < 2e-4)).alias("rates_follow"), (tp > 0).alias("finds_some"))


for _key, _table in (("ensemble_detect_table", "events"), ("ensemble_detect_text", "documents"), ("evaluate_injected", "orders")):
    register(f"{_key}_laws", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, {_METRICS.format(t=_table)}")(
        lambda spark, sf, key=_key: _metric_laws(cat.QUERIES[key](spark, sf)))
