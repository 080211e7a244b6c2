"""Label audit: out-of-fold class probabilities from canary models and the
per-row log loss; rows above the loss quantile are suspicious.

Rows become sparse (positions and values of the non-zero features), so a category
column of any cardinality is one entry per row.  The logistic regressions of all folds
are fitted together, one pass over the rows per step (see ``logistic``).  Their objective
is sum(w*loss) + |b|^2/2; balanced class weights are n/(classes * n_class) per fold.
Rows with a null label are not audited.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowaudit.functions.numeric import clean_nonfinite
from rowaudit.functions.text import tokens
from rowaudit.operators.clean import standard_scale
from rowaudit.operators.flags import finding
from rowaudit.operators.logistic import Space, fit_folds, predict_folds
from rowaudit.operators.rows import stratified_folds
from rowaudit.operators.rules import numeric_value
from rowaudit.operators.stats import exact_quantile, smallest_class
from rowaudit.operators.text import stop_words
from rowaudit.session import cut_lineage

EPS = 1e-15
#: Lookup tables of values up to this many bytes are broadcast, larger ones are joined by shuffle.
LOOKUP_BYTES = 32 << 20


def _numbered(df: DataFrame, value: Column, name: str) -> tuple[DataFrame, list[str], list[int]]:
    """Adds ``name``, the 0-based place of the value's text among the sorted distinct ones (null for
    null), and returns the values and their counts.  The models hold a coefficient per value, so
    the list is no larger than what the driver has to keep for them."""
    key = value.cast("string")
    got = sorted(tuple(r) for r in df.groupBy(key.alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null").collect())
    values, counts = [v for v, _ in got], [n for _, n in got]
    lookup = df.sparkSession.createDataFrame(pa.table({f"_v_{name}": pa.array(values, pa.string()), name: pa.array(range(len(values)), pa.int32())}))
    if sum(map(len, values)) + 16 * len(values) <= LOOKUP_BYTES:
        lookup = F.broadcast(lookup)
    return df.join(lookup, key == F.col(f"_v_{name}"), "left").drop(f"_v_{name}"), values, counts


def index_labels(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """0-based label index in ascending text order; rows with a null label are left out."""
    d, labels, _ = _numbered(df.where(F.col(label).isNotNull()), F.col(label), "label_idx")
    return d, labels


@dataclass(frozen=True)
class Design:
    """rows: (row_id, label, label_idx, cols, vals); per column its mean and population sd (1 for a
    constant), and its name."""
    rows: DataFrame
    mean: np.ndarray
    sd: np.ndarray
    names: list[str]


def sparse_rows(df: DataFrame, features: list[str], types: dict[str, str], label: str) -> Design:
    """Numeric features (missing/non-finite -> 0) and one column per category (null -> none).
    ``df`` has label_idx."""
    numeric = [c for c in features if types.get(c, "Numerical") == "Numerical"]
    d = df.select("row_id", label, "label_idx", *[clean_nonfinite(numeric_value(df, c)).cast("double").alias(f"_f_{i}") for i, c in enumerate(numeric)],
                  *[F.col(c).cast("string").alias(f"_s_{i}") for i, c in enumerate(features) if c not in numeric])
    st = d.agg(F.count(F.lit(1)).alias("n"), *[f(f"_f_{i}").alias(f"{a}{i}") for i in range(len(numeric)) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, sd, names = [st[f"m{i}"] or 0.0 for i in range(len(numeric))], [st[f"s{i}"] or 0.0 for i in range(len(numeric))], list(numeric)
    cols, vals = [F.lit(i) for i in range(len(numeric))], [F.col(f"_f_{i}") for i in range(len(numeric))]
    for i, c in enumerate(features):
        if c not in numeric:
            d, values, counts = _numbered(d, F.col(f"_s_{i}"), f"_c_{i}")
            share = [x / st["n"] for x in counts]
            cols.append(F.col(f"_c_{i}") + len(mean))
            vals.append(F.lit(1.0))
            mean += share
            sd += [(p * (1.0 - p)) ** 0.5 for p in share]
            names += [f"{c}={v}" for v in values]
    pairs = F.filter(F.arrays_zip(F.array(*cols).alias("c"), F.array(*vals).alias("v")), lambda x: x["c"].isNotNull() & (x["v"] != 0))
    rows = d.select("row_id", label, "label_idx", pairs.alias("_p")).select(
        "row_id", label, "label_idx", F.col("_p.c").cast("array<int>").alias("cols"), F.col("_p.v").cast("array<double>").alias("vals"))
    deviation = np.array([x if x > 0 else 1.0 for x in sd])
    return Design(rows, np.array(mean), deviation, names)


def _fold_counts(rows: DataFrame, k: int, classes: int) -> np.ndarray:
    """Rows by fold and class, from one aggregate."""
    out = np.zeros((k, classes))
    for f, c, n in rows.groupBy("fold", "label_idx").agg(F.count(F.lit(1))).collect():
        out[f, c] = n
    return out


def _class_weights(counts: np.ndarray, balanced: bool) -> np.ndarray:
    """Weights by model and class; a model is fitted on the rows outside its fold."""
    train = counts.sum(0) - counts
    if not balanced:
        return np.ones_like(train)
    present = (train > 0).sum(1, keepdims=True)
    return np.where(train > 0, train.sum(1, keepdims=True) / (present * np.maximum(train, 1)), 0.0)


def logistic_out_of_fold(design: Design, label: str, classes: int, k: int, seed: int = 42, balanced: bool = True) -> DataFrame:
    """(row_id, label_idx, probability, prediction) by logistic regressions over shuffled folds."""
    rows = cut_lineage(stratified_folds(design.rows, label, k, seed=seed, shuffle=True).select("row_id", "fold", "label_idx", "cols", "vals"))
    weight = _class_weights(_fold_counts(rows, k, classes), balanced)
    space = Space(np.tile(1.0 / design.sd, (k, 1)), np.tile(design.mean, (k, 1)), weight)
    theta, _ = fit_folds(rows, space)
    return predict_folds(rows, space, theta)


def out_of_fold(df: DataFrame, k: int, make_model, fold_col: str = "fold") -> DataFrame:
    """(row_id, label_idx, probability, prediction) for every row, each
    predicted by a Spark ML model fitted on the other folds."""
    parts = []
    for f in range(k):
        model = make_model().fit(df.where(F.col(fold_col) != f))
        parts.append(model.transform(df.where(F.col(fold_col) == f)).select("row_id", "label_idx", "probability", "prediction"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_loss(pred: DataFrame) -> DataFrame:
    plain = pred.schema["probability"].dataType.typeName() == "array"
    p = (F.col("probability") if plain else vector_to_array("probability"))[F.col("label_idx").cast("int")]
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))
    return pred.withColumn("p_true", p).withColumn("loss", -F.log(F.col("p_true")))


def flag_high_loss(scored: DataFrame, quantile: float = 0.95, name: str = "p3") -> DataFrame:
    thr = exact_quantile(scored, "loss", quantile)
    reason = F.concat(F.lit("Suspicious label loss="), F.format_string("%.2f", F.col("loss")))
    return scored.withColumn(name, F.when(F.col("loss") > F.lit(thr), finding(0, None, reason, F.col("loss"))))


def _gate(df: DataFrame, label: str, folds: int, min_rows: int) -> int:
    """Number of folds, or 0 where there are too few rows or a class has fewer than two."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.min("n").alias("least")).first()
    if (counts["n"] or 0) < min_rows or (counts["least"] or 0) < 2:
        return 0
    return min(folds, counts["least"])


def audit_table(df: DataFrame, features: list[str], types: dict[str, str], label: str,
                folds: int = 5, quantile: float = 0.95, seed: int = 42, min_rows: int = 20,
                name: str = "p3") -> DataFrame | None:
    """Tabular phase 3; None when a gate fails (< min_rows rows, smallest class < 2)."""
    k = _gate(df, label, folds, min_rows) if features else 0
    if not k:
        return None
    d, labels = index_labels(df, label)
    pred = logistic_out_of_fold(sparse_rows(d, features, types, label), label, len(labels), k, seed)
    return flag_high_loss(cut_lineage(with_loss(pred)), quantile, name)


VOCABULARY = 5000


def _term_counts(rows: DataFrame) -> DataFrame:
    """(fold, term, cf, df): occurrences and documents of each term, by fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cf, df = Counter(), Counter()
            for f, words in zip(batch.column("fold").to_pylist(), batch.column("toks")):
                found = Counter(words.as_py())
                for t, n in found.items():
                    cf[f, t] += n
                    df[f, t] += 1
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in cf], pa.int32()), pa.array([t for _, t in cf], pa.string()),
                                              pa.array(list(cf.values()), pa.int64()), pa.array([df[x] for x in cf], pa.int64())],
                                             names=["fold", "term", "cf", "df"])

    found = rows.select("fold", "toks").mapInArrow(run, "fold int, term string, cf long, df long").where(~F.col("term").isin(stop_words()))
    return found.groupBy("fold", "term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def text_space(rows: DataFrame, k: int, classes: int, vocabulary: int = VOCABULARY) -> tuple[dict[str, int], Space]:
    """The terms that some model uses, and what each model sees of them: its ``vocabulary`` most
    frequent terms outside its fold (ties by term) with their smooth idf there."""
    counts = _fold_counts(rows, k, classes)
    n_train = counts.sum() - counts.sum(1)
    wide = cut_lineage(_term_counts(rows).groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("fold") != f, F.col(c))), F.lit(0)).alias(f"{c}{f}")
                                                                 for f in range(k) for c in ("cf", "df")]))
    chosen = [wide.where(f"cf{f} > 0").orderBy(F.desc(f"cf{f}"), "term").limit(vocabulary).select("term", f"df{f}").collect() for f in range(k)]
    terms = {t: i for i, t in enumerate(sorted({r[0] for some in chosen for r in some}))}
    scale = np.zeros((k, len(terms)))
    for f, some in enumerate(chosen):
        for t, df in some:
            scale[f, terms[t]] = np.log((1.0 + n_train[f]) / (1.0 + df)) + 1.0
    return terms, Space(scale, np.zeros_like(scale), _class_weights(counts, False), unit=True)


def _term_rows(rows: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(row_id, fold, label_idx, cols, vals): counts of the given terms (at most folds x vocabulary)."""
    src = rows.select("row_id", "fold", "label_idx", "toks")
    schema = src.drop("toks").select("*", F.lit(None).cast("array<int>").alias("cols"), F.lit(None).cast("array<double>").alias("vals")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, vals, ends = [], [], [0]
            for words in batch.column("toks"):
                found = Counter(words.as_py())
                mine = [t for t in found if t in terms]
                cols += [terms[t] for t in mine]
                vals += [float(found[t]) for t in mine]
                ends.append(len(cols))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.ListArray.from_arrays(at, pa.array(cols, pa.int32())),
                                              pa.ListArray.from_arrays(at, pa.array(vals, pa.float64()))], names=schema.names)

    return src.mapInArrow(run, schema)


def audit_text(df: DataFrame, text_col: str, label: str, folds: int = 5, quantile: float = 0.95,
               min_rows: int = 20, name: str = "p3") -> DataFrame | None:
    """Text phase 3: TF-IDF + logistic regression canary, unshuffled folds.  Vocabulary and idf are
    those of each model's own training rows, from one count by fold."""
    k = _gate(df, label, folds, min_rows)
    if not k:
        return None
    d, labels = index_labels(df.select("row_id", label, text_col), label)
    split = stratified_folds(d.select("row_id", label, "label_idx"), label, k, shuffle=False).select("row_id", "fold")
    rows = d.join(split, "row_id").select("row_id", "fold", "label_idx", tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("toks"))
    rows = cut_lineage(rows)
    terms, space = text_space(rows, k, len(labels))
    sparse = cut_lineage(_term_rows(rows, terms))
    theta, _ = fit_folds(sparse, space)
    return flag_high_loss(cut_lineage(with_loss(predict_folds(sparse, space, theta))), quantile, name)


def vector_rows(df: DataFrame, features: list[str], types: dict[str, str], label: str, k: int, seed: int) -> DataFrame:
    """(row_id, fold, label_idx, features): sparse Spark ML vectors, unscaled; the encoder's dropped
    slot is the one of null categories."""
    numeric = [c for c in features if types.get(c, "Numerical") == "Numerical"]
    other = [c for c in features if c not in numeric]
    d = df.select("row_id", label, "label_idx", *[clean_nonfinite(numeric_value(df, c)).alias(f"_f_{c}") for c in numeric],
                  *[F.col(c).cast("string").alias(f"_s_{c}") for c in other])
    stages = [VectorAssembler(inputCols=[f"_f_{c}" for c in numeric] + [f"_o_{c}" for c in other], outputCol="features")]
    if other:
        stages = [StringIndexer(inputCols=[f"_s_{c}" for c in other], outputCols=[f"_i_{c}" for c in other], handleInvalid="keep"),
                  OneHotEncoder(inputCols=[f"_i_{c}" for c in other], outputCols=[f"_o_{c}" for c in other], dropLast=True)] + stages
    d = Pipeline(stages=stages).fit(d).transform(d).select("row_id", label, "label_idx", "features")
    return cut_lineage(stratified_folds(d, label, k, seed=seed).select("row_id", "fold", "label_idx", "features"))


def model_disagreement(df: DataFrame, features: list[str], types: dict[str, str], label: str,
                       folds: int = 5, seed: int = 42, min_rows: int = 20, name: str = "p3dis") -> DataFrame | None:
    """Rows where out-of-fold predictions of logistic regression, random forest and Gaussian
    naive Bayes do not all agree; None when a gate fails, as in ``audit_table``."""
    k = _gate(df, label, folds, min_rows) if features else 0
    if not k:
        return None
    d, labels = index_labels(df, label)
    preds = logistic_out_of_fold(sparse_rows(d, features, types, label), label, len(labels), k, seed, balanced=False).select(
        "row_id", F.col("prediction").alias("pred_lr"))
    rows = vector_rows(d, features, types, label, k, seed)
    makers = {
        "rf": lambda: RandomForestClassifier(featuresCol="features", labelCol="label_idx", numTrees=50, seed=seed),
        "nb": lambda: NaiveBayes(featuresCol="features", labelCol="label_idx", modelType="gaussian"),
    }
    for key, mk in makers.items():
        preds = preds.join(out_of_fold(rows, k, mk).select("row_id", F.col("prediction").alias(f"pred_{key}")), "row_id")
    n_distinct = F.size(F.array_distinct(F.array("pred_lr", "pred_rf", "pred_nb")))
    return preds.withColumn("n_distinct", n_distinct).withColumn(
        name, F.when(F.col("n_distinct") > 1, finding(0, None, "Model disagreement", F.col("n_distinct"))))


def gbt_probabilities(df: DataFrame, features: list[str], types: dict[str, str], label: str,
                      folds: int = 5, seed: int = 42, max_iter: int = 20, min_rows: int = 20) -> DataFrame | None:
    """Out-of-fold GBT probabilities: binary GBT, or one binary GBT per class
    (one-vs-rest) with the positive probabilities normalised; None when a gate fails."""
    k = _gate(df, label, folds, min_rows) if features else 0
    if not k:
        return None
    d, labels = index_labels(df, label)
    d = vector_rows(d, features, types, label, k, seed)
    if len(labels) == 2:
        pred = out_of_fold(d, k, lambda: GBTClassifier(featuresCol="features", labelCol="label_idx", maxIter=max_iter, seed=seed))
        return with_loss(pred)
    per_class = []
    for ci in range(len(labels)):
        dc = d.withColumn("_y", (F.col("label_idx") == ci).cast("double"))
        parts = []
        for f in range(k):
            tr, te = dc.where(F.col("fold") != f), dc.where(F.col("fold") == f)
            m = GBTClassifier(featuresCol="features", labelCol="_y", maxIter=max_iter, seed=seed).fit(tr)
            parts.append(m.transform(te).select("row_id", vector_to_array("probability")[1].alias(f"_p{ci}")))
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        per_class.append(u)
    j = per_class[0]
    for p in per_class[1:]:
        j = j.join(p, "row_id")
    total = sum((F.col(f"_p{ci}") for ci in range(1, len(labels))), F.col("_p0"))
    j = j.join(d.select("row_id", "label_idx"), "row_id")
    p_true = F.element_at(F.array(*[F.col(f"_p{ci}") for ci in range(len(labels))]), F.col("label_idx").cast("int") + 1) / total
    p_true = F.least(F.greatest(p_true, F.lit(EPS)), F.lit(1.0 - EPS))
    return j.withColumn("p_true", p_true).withColumn("loss", -F.log("p_true"))


def top_loss_rows(scored: DataFrame, labels: list[str], n: int = 20) -> DataFrame:
    """Top-n rows by loss with original and predicted label (a top-n report)."""
    lab = F.array(*[F.lit(x) for x in labels])
    return scored.orderBy(F.desc("loss"), F.asc("row_id")).limit(n).select(
        "row_id", "loss", F.element_at(lab, F.col("label_idx").cast("int") + 1).alias("label"),
        F.element_at(lab, F.col("prediction").cast("int") + 1).alias("predicted"))


def pca_2d(df: DataFrame, cols: list[str]) -> DataFrame:
    """Two-dimensional projection (x, y) of the scaled numeric columns."""
    s = standard_scale(df, cols)
    v = VectorAssembler(inputCols=cols, outputCol="_v").transform(s)
    m = PCA(k=2, inputCol="_v", outputCol="_pc").fit(v)
    t = m.transform(v).withColumn("_a", vector_to_array("_pc"))
    return t.select("row_id", F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"))
