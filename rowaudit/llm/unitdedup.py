r"""Substring dedup by unit hashing: paragraphs, lines and sentences are normalised and hashed,
equal digests are grouped over the whole corpus, the earliest occurrence stays and the others
are removed, with their offsets in the original text.

``unit`` is ``line`` (text between line feeds), ``paragraph`` (between blank lines),
``sentence`` (lines cut further at sentence ends; a passage that was pasted into the middle
of a line still has whole sentences inside) or ``all`` of them.  Units of several kinds nest
and never cross; what is removed is their union, and every word of it stays at an earlier
place.  Nested units of the same words count once, as the innermost.  Units with fewer than
``min_words`` words, each kind counted as a whole, are left alone; in scripts without spaces
``DENSE_CHARS`` letters count as a word.  Normal form: lower case, every run of other
characters than letters, digits and underscores is one space.  Digests have 128 bits.

Two maps over Arrow batches find the units; between them only digests, ids and offsets are
shuffled.  The earliest occurrence is a minimum with map-side combine, and the removal is
a plain join that adaptive execution can split, so a line that a third of all documents
share costs no task more than its share.

The order of occurrences is: document id (null last), hash of the text, offset.  Offsets
are code points, end exclusive.  Defined cases: null and empty texts have no units; rows
equal in id and text count as one document and get equal results; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.llm.common import fresh

MIN_WORDS, DENSE_CHARS = 6, 2
SEPARATORS = {
    "sentence": re.compile(r"\n|(?<=[.!?])\s+|(?<=[。！？｡])(?![。！？｡])"),
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n[^\S\n]*\n"),
}
_GAP, _LETTER = re.compile(r"\W+"), re.compile(r"\w")
#: Letters of scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_DENSE = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                    "\uff66-\uff9f\U00020000-\U0003ffff]")


def _words(normal: str) -> int:
    if normal.isascii() or not (dense := len(_DENSE.findall(normal))):
        return normal.count(" ") + 1 if normal else 0
    return len(_DENSE.sub(" ", normal).split()) + dense // DENSE_CHARS


def split_units(text: str, unit: str = "all", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normal form) of the units with enough words, by start."""
    found: dict[tuple[int, int], tuple[int, int, int, str]] = {}
    for name in SEPARATORS if unit == "all" else (unit,):
        at = 0
        for m in [*SEPARATORS[name].finditer(text), None]:
            end = len(text) if m is None else m.start()
            if end > at:
                normal = _GAP.sub(" ", text[at:end].lower()).strip()
                n = _words(normal)
                if n >= min_words:  # nested units with the same first word and length are the same words
                    found.setdefault((_LETTER.search(text, at, end).start(), len(normal)), (at, end, n, normal))
            at = end if m is None else m.end()
    yield from sorted(found.values())


def units(docs: DataFrame, *, text: str = "text", key: str = "doc_id", unit: str = "all", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tie, start, end, n_words, h1, h2) of every unit."""
    src = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("tie"), docs[text].alias("body"))
    schema = T.StructType([*src.schema[:2], *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "n_words")),
                           *(T.StructField(c, T.LongType()) for c in ("h1", "h2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                at, spans, digests = [], [], []
                for i, x in enumerate(part.column(2)):
                    for a, b, n, normal in split_units(x.as_py() or "", unit, min_words):
                        at.append(i)
                        spans.append((a, b, n))
                        digests.append(xxhash.xxh3_128_digest(normal.encode()))
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                s = np.array(spans, np.int32).reshape(-1, 3)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *(pa.array(s[:, k]) for k in range(3)),
                     pa.array(h[:, 0]), pa.array(h[:, 1])], names=schema.names)

    return src.mapInArrow(run, schema)


def _rank() -> Column:
    return F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("tie").alias("tie"), F.col("start").alias("start"))


def repeated_units(docs: DataFrame, *, text: str = "text", key: str = "doc_id", unit: str = "all",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """The units to remove: (id, tie, start, end, n_words, first_id, first_start); first_* is
    the occurrence that stays."""
    found = units(docs, text=text, key=key, unit=unit, min_words=min_words)
    first = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(_rank()).alias("first")).where("n > 1").drop("n")
    out = found.join(first, ["h1", "h2"]).where(_rank() != F.col("first"))
    return out.select("id", "tie", "start", "end", "n_words", F.col("first.id").alias("first_id"),
                      F.col("first.start").alias("first_start"))


def remove_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", unit: str = "all",
                   min_words: int = MIN_WORDS, spans: str = "removed") -> DataFrame:
    """All rows of ``docs`` with the union of the repeated units cut out of the text, and a column
    of the removed spans in the original text.  A list of spans is never longer than its document."""
    t, i2, t2 = fresh(docs, "_ut", "_ui2", "_ut2")
    docs = docs.drop(*[c for c in docs.columns if c.lower() == spans.lower()])
    gone = repeated_units(docs, text=text, key=key, unit=unit, min_words=min_words).select("id", "tie", "start", "end").distinct()
    wider = Window.partitionBy("id", "tie").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)  # one document
    gone = gone.withColumn("upto", F.coalesce(F.max("end").over(wider), F.lit(0))).where("end > upto")  # outermost units
    per_doc = gone.groupBy(F.col("id").alias(i2), F.col("tie").alias(t2)).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))
    df = docs.withColumn(t, F.xxhash64(text)).join(per_doc, F.col(key).eqNullSafe(F.col(i2)) & (F.col(t) == F.col(t2)), "left")
    # pieces between the removed spans
    last = F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end")))
    ends = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), spans)
    pieces = F.zip_with(ends, F.concat(F.col(spans), last),
                        lambda a, b: F.substring(F.col(text), a["end"] + 1, b["start"] - a["end"]))
    return df.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))).drop(t, i2, t2)
