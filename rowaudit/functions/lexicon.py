"""A small self-written opinion lexicon (word, polarity, subjectivity).

The reference relies on a third-party lexicon that is not available here, so
scores will not equal its numbers; callers can pass their own lexicon as a
DataFrame with the same three columns.  Lookups stay inside one projection
(a literal map + higher-order functions) when the lexicon is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowaudit.functions.text import tokens

# Fixed values: (word, polarity, subjectivity).
DEFAULT_LEXICON = [
    ("good", 0.7, 0.6), ("great", 0.8, 0.75), ("excellent", 1.0, 1.0), ("best", 1.0, 0.3),
    ("love", 0.5, 0.6), ("loved", 0.7, 0.8), ("nice", 0.6, 1.0), ("happy", 0.8, 1.0),
    ("wonderful", 1.0, 1.0), ("amazing", 0.6, 0.9), ("beautiful", 0.85, 1.0), ("perfect", 1.0, 1.0),
    ("fine", 0.4, 0.5), ("fun", 0.3, 0.2), ("interesting", 0.5, 0.5), ("enjoy", 0.4, 0.5),
    ("recommend", 0.3, 0.4), ("fantastic", 0.4, 0.9), ("brilliant", 0.9, 1.0), ("pleasant", 0.7, 0.9),
    ("bad", -0.7, 0.67), ("worst", -1.0, 1.0), ("terrible", -1.0, 1.0), ("awful", -1.0, 1.0),
    ("poor", -0.4, 0.6), ("boring", -1.0, 1.0), ("hate", -0.8, 0.9), ("horrible", -1.0, 1.0),
    ("sad", -0.5, 1.0), ("ugly", -0.7, 1.0), ("wrong", -0.5, 0.9), ("stupid", -0.8, 1.0),
    ("disappointing", -0.6, 0.7), ("waste", -0.2, 0.4), ("annoying", -0.8, 0.9), ("weak", -0.4, 0.6),
    ("free", 0.4, 0.8), ("profit", 0.2, 0.5), ("cheap", 0.4, 0.7), ("fake", -0.5, 1.0),
    ("new", 0.14, 0.45), ("old", 0.1, 0.2), ("big", 0.0, 0.1), ("small", -0.25, 0.4),
    ("important", 0.4, 1.0), ("simple", 0.0, 0.36), ("easy", 0.43, 0.83), ("hard", -0.3, 0.5),
    ("strange", -0.05, 0.15), ("clear", 0.1, 0.38), ("true", 0.35, 0.65), ("false", -0.4, 0.6),
    ("really", 0.2, 0.2), ("very", 0.2, 0.3), ("quite", 0.0, 1.0), ("too", 0.0, 0.6),
    ("always", 0.0, 0.5), ("never", 0.0, 0.5), ("maybe", 0.0, 0.5), ("probably", 0.0, 0.5),
    ("bon", 0.6, 0.6), ("mauvais", -0.6, 0.6), ("gut", 0.6, 0.6), ("schlecht", -0.6, 0.6),
    ("bueno", 0.6, 0.6), ("malo", -0.6, 0.6),
]

# Lexicons up to this size are inlined as a map literal (no join, no shuffle).
INLINE_LIMIT = 50_000


def lexicon_df(spark, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or DEFAULT_LEXICON, "word string, polarity double, subjectivity double")


def _map_literal(rows, idx: int) -> Column:
    kv = []
    for r in rows:
        kv += [F.lit(r[0]), F.lit(float(r[idx]))]
    return F.create_map(*kv)


def lexicon_mean(text: Column, rows=None, which: str = "subjectivity") -> Column:
    """Mean polarity/subjectivity of the text's lexicon words, 0 if none."""
    rows = [r for r in (DEFAULT_LEXICON if rows is None else rows) if r[1 if which == "polarity" else 2] is not None]
    if not rows:
        return F.lit(0.0)
    m = _map_literal(rows, 1 if which == "polarity" else 2)
    found = F.filter(F.transform(tokens(text), lambda t: F.element_at(m, t)), lambda v: v.isNotNull())
    # one pass over the token scores: (sum, count) -> mean, 0 when no word is known
    acc0 = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    agg = F.aggregate(found, acc0, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["n"] + 1).alias("n")),
                      lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(F.lit(0.0)))
    return F.coalesce(agg, F.lit(0.0))  # null text: no words


def one_per_word(lexicon: DataFrame) -> DataFrame:
    """A repeated word gets the mean of its scores; null scores and null words do not count."""
    return (lexicon.where(F.col("word").isNotNull()).groupBy("word")
            .agg(F.avg("polarity").alias("polarity"), F.avg("subjectivity").alias("subjectivity")))


def lexicon_rows(lexicon: DataFrame | None):
    """Rows of a lexicon DataFrame if its size is within INLINE_LIMIT, else None."""
    if lexicon is None:
        return DEFAULT_LEXICON
    lexicon = one_per_word(lexicon)
    if lexicon.count() > INLINE_LIMIT:
        return None
    return [(r[0], r[1], r[2]) for r in lexicon.select("word", "polarity", "subjectivity").collect()]


def lexicon_scores(df: DataFrame, text_col: str, lexicon: DataFrame | None = None,
                   which: str = "subjectivity", name: str | None = None) -> DataFrame:
    """Add the mean lexicon score.  Small lexicon: inline map (map-only).
    Large lexicon: explode tokens, join (shuffle) and average per row."""
    name = name or which
    rows = lexicon_rows(lexicon)
    if rows is not None:
        return df.withColumn(name, lexicon_mean(F.col(text_col), rows, which))
    toks = df.select("row_id", F.explode(tokens(F.col(text_col))).alias("word"))
    s = toks.join(one_per_word(lexicon).select("word", F.col(which).alias("_s")), "word") \
        .groupBy("row_id").agg(F.avg("_s").alias(name))
    return df.join(s, "row_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
