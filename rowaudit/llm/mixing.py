"""Mixing sources to target weights with hash-random order, prefix sums and exact
cuts.  DataFrame functions only.

Each document gets a random key (md5 of seed and id).  Inside a source the documents
are ordered by that key; the key's leading hex digits are range buckets, so a source
with most of the rows is spread over ``16 ** digits`` groups.  Word counts are summed
per (source, bucket), turned into bucket offsets by one running sum per source over
those few rows, and completed inside each bucket by a window.  A source's budget is
then cut exactly: whole epochs first, the rest from the front of the order; the
document at the cut contributes only the words that still fit.

Targets: sources in code point order (null last) have the weights 5, 2, 1, repeating,
of the total; no target exceeds ``max_epochs`` times its source, and the excess goes
to the others by weight.  With c = cap and w = weight this is min(c, L * w) with one
level L: sort sources by c / w, and L is the largest (total - caps before) / (weights
from here on).

Defined cases: null text counts 0 words and takes 0; a null source is a source of its
own; null ids share one key and are ordered by size and text hash; equal rows are
interchangeable.  An empty table, or one without words, gives targets 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowaudit.llm.common import BLANK, fresh, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that one bucket of a source should hold at most.
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, source: str, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` has one row per source with ``source_size``; adds ``target``.  The windows
    run over one row per source."""
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    df = sizes.withColumn("_w", w).withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    df = df.withColumn("_level", (F.sum(F.col("source_size").cast("double")).over(whole)
                                  - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    df = df.withColumn("target", F.least("_cap", F.max("_level").over(whole) * F.col("_w")))
    return df.drop("_w", "_cap", "_level")


def plan_mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix",
             weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """All rows and columns of ``docs`` plus size, source_size, target and taken.
    A column of ``docs`` that has a result's name is replaced."""
    made = {"size", "source_size", "target", "taken"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    k, b, off, src, s2, b2, tie = fresh(docs, "_mk", "_mb", "_mo", "_ms", "_ms2", "_mb2", "_mt")
    digits = max(2, math.ceil(math.log(max(docs.count(), 1) / BUCKET_ROWS, 16)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    keyed = docs.withColumns({"size": word_count(F.col(text)), k: order, src: F.col(source), tie: F.xxhash64(text)})
    keyed = keyed.withColumn(b, F.substring(k, 1, digits))
    sums = keyed.groupBy(src, b).agg(F.sum("size").alias("_n"))
    per_source = sums.groupBy(src).agg(F.sum("_n").alias("source_size"))
    targets = source_targets(per_source, src, weights, max_epochs).withColumnRenamed(src, s2)
    running = Window.partitionBy(src).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn(off, F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    offsets = offsets.join(targets, F.col(src).eqNullSafe(F.col(s2))).drop(s2)
    offsets = offsets.withColumnRenamed(src, s2).withColumnRenamed(b, b2)
    df = keyed.join(offsets, F.col(src).eqNullSafe(F.col(s2)) & (F.col(b) == F.col(b2))).drop(s2, b2)
    inside = Window.partitionBy(src, b).orderBy(k, key, "size", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.col(off) + F.sum("size").over(inside) - F.col("size")
    budget = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - ahead, F.lit(0)), F.col("size"))
    return df.withColumn("taken", taken.cast("long")).drop(k, b, off, src, tie)


def write_mix(planned: DataFrame, *, text: str = "text") -> DataFrame:
    """The mixed corpus: each document once per epoch, the last copy cut after the words
    that still fit.  Drops the planning columns; ``n_chars`` follows the text where present."""
    (part,) = fresh(planned, "_mp")
    full = F.floor(F.col("taken") / F.col("size"))
    cut = F.col("taken") - full * F.col("size")
    parts = F.transform(F.sequence(F.lit(1).cast("long"), full + 1), lambda i: F.when(i <= full, F.col("size")).otherwise(cut))
    df = planned.where(F.col("taken") > 0).withColumn(part, F.explode(parts)).where(F.col(part) > 0)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"[{BLANK}]*[^{BLANK}]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, F.col(part).cast("int")), "")
    short = F.col(part) < F.col("size")
    df = df.withColumn(text, F.when(short, head).otherwise(F.col(text)))
    if "n_chars" in df.columns:
        kind = planned.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.when(short, F.length(text)).otherwise(F.col("n_chars")).cast(kind))
    return df.drop(part, "size", "source_size", "target", "taken")
