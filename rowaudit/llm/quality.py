"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and
the raw corpus, plus simple base counts.  DataFrame functions only.

Two steps, each one pass over the texts:

1. every word and word pair of every document is hashed into ``buckets`` bins and
   counted, for all documents (raw) and for the trusted ones (target); map-side combine
   leaves at most ``buckets`` rows per task.  The trusted documents are marked where they are
   read, by a Bloom filter of bounded size over their ids.  The documents that it marks wrongly
   are found by a join of ids alone, and their counts are taken off again; only their texts
   (about one in seventy, and as many of the trusted) are shuffled;
2. the log ratio of the two smoothed multinomials, a fixed-point long per bin, is
   an array constant of ``buckets`` entries; each document sums its bins and
   divides by its number of n-grams.

Sums of longs do not depend on the order, so the verdict of a document is the same
in every run.

Defined cases: a null or blank text has no words, all counts 0, fails the base rule
and is not kept.  Repeated rows are judged one by one and stay.  An empty table
gives an empty result.  With no trusted document the ratio is 0 everywhere and only
the base rule decides.  A document whose id is null is never trusted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowaudit.llm.common import fresh, let, staged, words

BUCKETS = 1 << 14
SCALE = 1 << 20
THRESHOLD = -0.1
#: Pseudo-count per bin; keeps rare bins of small corpora near ratio 0.
PRIOR = 4.0
#: Bits of the filter over the trusted ids (4 MB).
MAX_FILTER_BITS = 1 << 25
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30


def _skip(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def _pairs(a: Column, gap: int) -> Column:
    """Hash of each element with the one ``gap`` places on."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - gap, F.lit(0))), _skip(a, gap), lambda x, y: F.xxhash64(x, y))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def _repeated_words(windows: Column, width: int) -> Column:
    """Words inside windows whose hash occurs twice or more in the array of windows."""
    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), _skip(at, 1), lambda a, b: F.least(b - a, F.lit(width)))
        return _total(F.transform(steps, lambda s: s.cast("long"))) + width

    def positions(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]).eqNullSafe(True))
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        let(let(ranked, positions), covered))


def grams(docs: DataFrame, text: str, keep: list[str], prefix: str = "_q") -> DataFrame:
    """``keep`` columns plus the arrays of word hashes and pair hashes of the text."""
    w, h, p = f"{prefix}w", f"{prefix}h", f"{prefix}p"
    df = docs.select(*[F.col(f"`{c}`") for c in keep], words(F.col(f"`{text}`")).alias(w))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    return df.withColumn(p, _pairs(F.col(h), 1))


def _slots(id_: Column, bits: int) -> list[Column]:
    """The places of an id in the filter."""
    return [F.pmod(F.xxhash64(id_, F.lit(i)), F.lit(bits)) for i in range(2)]


def id_filter(ids: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A Bloom filter over the ids: a table of one row, the array of its 64-bit words, and its bits; sixteen an id,
    ``MAX_FILTER_BITS`` at most (beyond that more documents pass that are not meant, and are counted off again)."""
    bits = min(MAX_FILTER_BITS, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    place = ids.select(F.explode(F.array(*_slots(F.col(column), bits))).alias("s"))
    words = place.groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("x"))
    got, out = words.toArrow(), np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["x"].to_numpy()
    lists = pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))
    return staged(ids.sparkSession.createDataFrame(pa.table({"words": lists})), "filter"), bits


def in_filter(id_: Column, words: tuple[DataFrame, int]) -> Column:
    """Whether the filter has the id.  Its words are the result of a subquery: as a constant, some 10 MB, they
    would stand in every plan, and in the texts of the plans that the driver keeps."""
    table, bits = words
    one, two = (F.getbit(F.get(table.scalar(), F.shiftright(s, 6).cast("int")), (s % 64).cast("int")) == 1 for s in _slots(id_, bits))
    return id_.isNotNull() & one & two


def fit_weights(docs: DataFrame, trusted: DataFrame, *, text: str = "text", key: str = "doc_id",
                buckets: int = BUCKETS) -> list[int]:
    """Fixed-point log ratio per bin.  ``trusted`` has the ids (column ``key``) of the
    target documents; statistics cover all documents and all trusted ones."""
    ids = staged(trusted.select(F.col(key).alias("_tid")).where(F.col("_tid").isNotNull()).distinct(), "trusted")
    texts = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"))

    def counts(some: DataFrame) -> dict[int, tuple[int, int]]:
        """All n-grams and those of marked documents, by bin."""
        g = grams(some, "_text", ["_in"]).select("_in", F.explode(F.concat("_qh", "_qp")).alias("_g"))
        rows = g.groupBy(F.pmod("_g", F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("_in").alias("m"))
        return {r["b"]: (r["n"], r["m"]) for r in rows.collect()}  # at most `buckets` rows

    # the filter marks the trusted documents and a few others; the latter are known by their ids alone
    mark = in_filter(F.col("_id"), id_filter(ids, "_tid"))
    both = counts(texts.withColumn("_in", mark.cast("long")))
    others = staged(texts.where(mark).select("_id").distinct().join(ids, F.col("_id") == F.col("_tid"), "left_anti"), "others")
    few = texts.where(mark & in_filter(F.col("_id"), id_filter(others, "_id"))).join(others, "_id", "left_semi")
    wrong = counts(few.withColumn("_in", F.lit(1).cast("long")))
    raw = {x: n for x, (n, _) in both.items()}
    good = {x: m - wrong.get(x, (0, 0))[1] for x, (_, m) in both.items()}
    n_raw, n_good = sum(raw.values()), sum(good.values())
    weights = [0] * buckets
    if n_good:
        # pseudo-counts in proportion to both totals: a bin without data has ratio 0
        lift = n_raw / n_good
        for b, n in raw.items():
            weights[b] = round(math.log((good.get(b, 0) + PRIOR) * lift / (n + PRIOR * lift)) * SCALE)
    return weights


def judge(docs: DataFrame, weights: list[int], *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with the counts, the ratio ``llr`` and ``kept``.
    A column of ``docs`` that has a result's name is replaced."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    (prefix,) = fresh(docs, "_q")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    keep = [c for c in docs.columns if c.lower() not in made or c == text]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = grams(docs, text, keep, prefix)
    w, h, p = (F.col(prefix + x) for x in "whp")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # prefix + "i": bins of all n-grams are looked up by position in a constant array
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    n = len(weights)
    df = df.withColumns({
        prefix + "4": _pairs(p, 2),
        prefix + "n": F.size(w).cast("long"),
        prefix + "c": F.length(F.array_join(w, "")).cast("long"),
        prefix + "s": (F.size(F.split(body, SYMBOLS, -1)) - 1).cast("long"),
        prefix + "d": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        prefix + "l": F.aggregate(F.concat(h, p), F.lit(0).cast("long"),
                                  lambda s, x: s + F.get(table, F.pmod(x, F.lit(n)).cast("int"))),
    })
    df = df.withColumn(prefix + "8", _pairs(F.col(prefix + "4"), 4))
    df = df.withColumn(prefix + "r", _repeated_words(F.col(prefix + "8"), WINDOW))
    n_words, n_rep = F.col(prefix + "n"), F.col(prefix + "r")
    failed = (n_words < MIN_WORDS) | (100 * n_rep > MAX_REPEAT_PERCENT * n_words)
    llr = F.when(n_words > 0, F.col(prefix + "l") / F.lit(SCALE) / (2 * n_words - 1)).otherwise(F.lit(0.0))
    out = df.select(*[F.col(f"`{c}`") for c in keep], n_words.alias("n_words"), F.col(prefix + "c").alias("word_chars"),
                    F.col(prefix + "s").alias("n_symbols"), F.col(prefix + "d").alias("n_dup_lines"),
                    n_rep.alias("n_repeat_words"), failed.alias("base_failed"), llr.alias("llr"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def keep(docs: DataFrame, weights: list[int], *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``judge``.  The row number in the
    filter stops the optimizer from moving the filter below the steps of ``judge``, where it
    would evaluate their array expressions many times over."""
    (n,) = fresh(docs, "_qn")
    out = judge(docs, weights, text=text, threshold=threshold).withColumn(n, F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col(n) >= 0)).drop(n)
