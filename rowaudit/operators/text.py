"""Text features: relational TF-IDF, character-trigram perplexity, hashed
TF-IDF embeddings.  All are explode / aggregate / join plans; the only
broadcast tables have a fixed bound (stop words, top-N vocabulary)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowaudit.functions.text import tokens
from rowaudit.operators.flags import finding
from rowaudit.session import cut_lineage, dealt_out, kept


def stop_words() -> list[str]:
    """Spark's default English stop-word list (packaged copy)."""
    txt = resources.files("rowaudit.functions").joinpath("stopwords_english.txt").read_text()
    return [w for w in txt.split("\n") if w]


def doc_terms(df: DataFrame, text_col: str, id_col: str = "row_id", drop_stop: bool = True) -> DataFrame:
    """(id, term, tf) term counts per document.  The texts are shuffled by document, not their terms:
    whatever is grouped by document later on finds its rows in place."""
    texts = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")).repartition("doc")
    t = texts.select("doc", F.explode(tokens(F.col("_text"))).alias("term"))
    if drop_stop:
        t = t.where(~F.col("term").isin(stop_words()))
    return t.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(df: DataFrame, text_col: str, id_col: str = "row_id", max_features: int = 5000) -> DataFrame:
    """Sparse TF-IDF as rows (id, term, weight): top ``max_features`` terms by
    corpus frequency (ties by term), smooth idf ln((1+n)/(1+df)) + 1, raw tf,
    L2-normalised per document."""
    n_docs = df.count()
    tf = doc_terms(df, text_col, id_col)
    stats = tf.groupBy("term").agg(F.sum("tf").alias("_freq"), F.count(F.lit(1)).alias("_df"))
    vocab = stats.orderBy(F.desc("_freq"), F.asc("term")).limit(max_features)  # bounded: the vocabulary
    vocab = vocab.select("term", (F.log((1.0 + n_docs) / (1.0 + F.col("_df"))) + 1.0).alias("_idf"))
    w = tf.join(F.broadcast(vocab), "term").withColumn("_w", F.col("tf") * F.col("_idf"))
    norms = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return w.join(norms, "doc").select(F.col("doc").alias(id_col), "term",
                                       (F.col("_w") / F.col("_norm")).alias("weight"))


def trigrams(text) -> "F.Column":
    """Overlapping character 3-grams of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), 1)


# trigram models up to this many entries are broadcast to score occurrences in place
MODEL_BROADCAST_ROWS = 2_000_000


def trigram_perplexity(df: DataFrame, text_col: str, id_col: str = "row_id", name: str = "perplexity") -> DataFrame:
    """Per-document perplexity under an add-one smoothed character trigram
    model fitted on the whole column: P(c|ab) = (n(abc)+1)/(n(ab.)+V), V =
    distinct third characters.  exp(-mean ln P) over the document's trigrams."""
    g = df.select(F.col(id_col).alias("_id"), F.explode(trigrams(F.col(text_col))).alias("_tri"))
    counts = g.groupBy("_tri").agg(F.count(F.lit(1)).alias("_c")).withColumn("_ctx", F.substring("_tri", 1, 2))
    counts = cut_lineage(counts)
    ctx = counts.groupBy("_ctx").agg(F.sum("_c").alias("_cc"))
    v = counts.select(F.substring("_tri", 3, 1).alias("ch")).distinct().count()
    model = counts.join(ctx, "_ctx").select("_tri", F.log((F.col("_c") + 1.0) / (F.col("_cc") + F.lit(float(v)))).alias("_lp"))
    n_model = counts.count()
    if n_model <= MODEL_BROADCAST_ROWS:
        # checked-size model: every trigram occurrence is scored in place (no shuffle of
        # the occurrences); the per-document average is map-side combined
        per = g.join(F.broadcast(model), "_tri").groupBy("_id").agg(F.exp(-F.avg("_lp")).alias(name))
    else:
        # large model: (document, trigram) counts first, so repeated trigrams join once
        dt = g.groupBy("_id", "_tri").agg(F.count(F.lit(1)).alias("_m"))
        per = dt.join(model, "_tri").groupBy("_id").agg(
            F.exp(-F.sum(F.col("_m") * F.col("_lp")) / F.sum("_m")).alias(name))
    return df.join(per.withColumnRenamed("_id", id_col), id_col, "left")


def perplexity_outliers(df: DataFrame, text_col: str, max_perplexity: float, name: str = "p1ppl") -> DataFrame:
    s = trigram_perplexity(df, text_col)
    return s.withColumn(name, F.when(F.col("perplexity") > max_perplexity,
                                     finding(6, text_col, "High perplexity", F.col("perplexity"))))


def embed_text(df: DataFrame, text_col: str, dim: int = 256, name: str = "embedding", encoder: Callable | None = None,
               components: int | None = None, batch: int = 64, once: bool = False) -> DataFrame:
    """Dense text vectors as array<double>; with ``components`` projected on the first principal axes.

    Without an encoder: hashed term counts -> IDF -> L2 norm, of length ``dim``.  ``encoder`` is a
    function without arguments that loads a model, once per worker process, and returns a function
    from a list of texts to a matrix; texts go to it ``batch`` at a time, a null one as empty.
    With ``once`` the rows are written with their term counts: hashed texts are read and split only once.
    """
    if encoder is not None:
        @F.pandas_udf("array<double>")
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _loaded(encoder)
            for some in texts:
                rows = some.fillna("").tolist()
                parts = [np.asarray(model(rows[i:i + batch]), float) for i in range(0, len(rows), batch)]
                yield pd.Series([x.tolist() for p in parts for x in p], index=some.index)

        out = df.withColumn(name, encode(F.col(text_col)))
    else:
        toks = df.withColumn("_toks", F.filter(tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda t: ~t.isin(stop_words())))
        tf = HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=dim).transform(toks)
        if once:
            tf = kept(dealt_out(tf.drop("_toks")), "terms")
        idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
        nrm = Normalizer(inputCol="_idf", outputCol="_n", p=2.0).transform(idf)
        out = nrm.withColumn(name, vector_to_array("_n")).drop("_toks", "_tf", "_idf", "_n")
    if components is None:
        return out
    out = cut_lineage(out).withColumn("_v", array_to_vector(name))
    axes = PCA(k=components, inputCol="_v", outputCol="_pc").fit(out)  # a distributed covariance
    return axes.transform(out).withColumn(name, vector_to_array("_pc")).drop("_v", "_pc")


_MODELS: dict = {}


def _loaded(encoder: Callable):
    """The model of an encoder, loaded once in this worker process."""
    key = (encoder.__module__, encoder.__qualname__)
    if key not in _MODELS:
        _MODELS[key] = encoder()
    return _MODELS[key]
