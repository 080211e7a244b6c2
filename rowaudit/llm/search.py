r"""Ranked lexical search, reversed: the documents are streamed through an index of the queries.

The items (queries) are few and the documents many, so the inverted index is built over the
items: term -> the items that hold it.  It is shipped to every task, and each document's term
counts run through it once:

1. ``term_hits`` (one map over Arrow batches): a document's number of terms and, for the terms
   that some item holds, their counts.  Staged; no text is shuffled.
2. Statistics of all documents: how many have a term, all terms, and the documents per term.
3. ``_stream`` (one map over the staged counts): the index adds each term's score to the items
   that hold it, in a small matrix of documents x items, and bounded heaps per item keep the best
   ``k`` of the task, so at most ``k`` rows per item leave a task.
4. The heaps are merged in two steps: within groups of tasks, then per item.

Terms are the maximal runs of ASCII letters and digits and of any characters beyond ASCII; only
A-Z are lower-cased.  The score is integer arithmetic (a BM25 with b = 0.9 and k1 = 0.8): with N
documents that have a term, L terms in all of them, n in this one, df documents with the term and
tf occurrences, w = floor(1000 ln((2N+2)/(2df+1))), m = 10 + (90 n N) div L, and the score is the
sum of w * ((10^9 tf) div (1000 tf + 8m)) over the item's terms, once each.

The index holds at most about ``BLOCK_TERMS`` (item, term) entries; more items are worked in more
blocks of items, each block against all documents, so what is shipped does not grow.

Defined cases: a null text has no term; a document without a term, or that shares none with an
item, has score 0 and is not returned; rows of equal item id are one item with the terms of all
its texts (a null id is an id); equal scores go by ascending document id, null ids last; repeated
documents are ranked one by one; an empty table of either kind gives an empty result; extra
columns are not read.  Very long texts cost time in proportion to their length.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.llm.common import staged

TOP = 10
#: (item, term) entries of one index, about 100 bytes each.
BLOCK_TERMS = 500_000
#: Documents scored at once, as cells of the matrix of documents x items.
CELLS = 1 << 20
MERGE_GROUPS = 32
#: Byte -> lower-case letter, digit or byte beyond ASCII; all others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Index:
    """Items and their terms: ``vocabulary`` gives a term's number; the items of term t are
    ``items[first[t]:first[t + 1]]``."""

    def __init__(self, rows: list[tuple]) -> None:
        by_item: dict = {}
        for item, text in rows:
            by_item.setdefault(item, set()).update(terms((text or "").encode()))
        self.ids = list(by_item)
        pairs = sorted((t, i) for i, found in enumerate(by_item.values()) for t in found)
        self.vocabulary: dict[bytes, int] = {}
        for t, _ in pairs:
            self.vocabulary.setdefault(t, len(self.vocabulary))
        self.items = np.array([i for _, i in pairs], np.int32)
        counts = np.bincount([self.vocabulary[t] for t, _ in pairs], minlength=len(self.vocabulary)) if pairs else np.empty(0, int)
        self.first = np.append(0, np.cumsum(counts)).astype(np.int64)


class Heaps:
    """The ``k`` best (score, document) of each item, worst first."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # scores below cannot enter

    def offer(self, item: int, score: int, doc: "Rank") -> None:
        heap, entry = self.heaps[item], (score, doc)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif heap[0] < entry:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


class Rank:
    """A document id in a heap: the smaller id is the better one, null is the worst."""
    __slots__ = ("id",)

    def __init__(self, id) -> None:
        self.id = id

    def __lt__(self, other: "Rank") -> bool:
        return other.id is not None and (self.id is None or self.id > other.id)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Rank) and self.id == other.id


def item_blocks(items: DataFrame, key: str, text: str, size: int = BLOCK_TERMS) -> Iterator[list[tuple]]:
    """The items in blocks of about ``size`` terms; rows of one id are in one block."""
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-int(total) // (5 * size)))  # a term and its gap have two characters at least, mostly six
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n))
    for i in range(n):
        yield [(r[0], r[1]) for r in items.where(part == i).select(key, text).orderBy(key, text).collect()]  # one block


def term_hits(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, counts): a document's number of terms, and those of the vocabulary."""
    src = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("doc", src.schema[0].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, counts, ends = [], [], [], [0]
            for x in batch.column(1).cast(pa.binary()):
                got = Counter(terms(x.as_py() or b""))
                n.append(got.total())
                for t in vocabulary.keys() & got.keys():
                    ids.append(vocabulary[t])
                    counts.append(got[t])
                ends.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int64()))], names=schema.names)

    return src.mapInArrow(run, schema)


def _stream(hits: DataFrame, index: Index, item_type: T.DataType, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc, score, task): the best ``k`` documents of each item and task."""
    schema = T.StructType([T.StructField("item", item_type), hits.schema["doc"], T.StructField("score", T.LongType())])
    ids, items, first = index.ids, index.items, index.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        heaps, step = Heaps(len(ids), k), max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                doc, n, lists, tf = some.column(0), some.column(1).to_numpy(), some.column(2), some.column(3).flatten().to_numpy()
                size = np.diff(lists.offsets.to_numpy())
                row, term = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
                m = 10 + 90 * n.astype(np.int64) * n_docs // n_terms
                part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                width = first[term + 1] - first[term]  # each hit counts for all items with the term
                to = np.repeat(first[term] - np.cumsum(width) + width, width) + np.arange(width.sum())
                score = np.zeros((len(size), len(ids)), np.int64)
                np.add.at(score, (np.repeat(row, width), items[to]), np.repeat(part, width))
                for r, i in zip(*np.nonzero(score >= heaps.least)):
                    if score[r, i] >= heaps.least[i]:
                        heaps.offer(int(i), int(score[r, i]), Rank(doc[int(r)].as_py()))
        found = [(i, s, d.id) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i, _, _ in found], to_arrow_type(item_type)), pa.array([d for _, _, d in found], to_arrow_type(schema[1].dataType)),
             pa.array([s for _, s, _ in found], pa.int64())], names=schema.names)

    return hits.mapInArrow(run, schema).withColumn("task", F.spark_partition_id())


def _best(found: DataFrame, k: int, *group) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, *, k: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
           item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc, score): the ``k`` documents of highest score above 0 for each item."""
    kind, out = items.schema[item_key].dataType, None
    for rows in item_blocks(items, item_key, item_text, block_terms):
        index = Index(rows)
        hits = staged(term_hits(docs, key, text, index.vocabulary), "term-hits")
        whole = hits.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("n_terms")).first()
        weights = np.zeros(len(index.vocabulary), np.int64)
        for t, df in hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term of the block
            weights[t] = weight(whole["n_docs"], df)
        found = _stream(hits, index, kind, weights, whole["n_docs"], max(1, whole["n_terms"] or 0), k)
        found = _best(found, k, "item", F.col("task") % MERGE_GROUPS).select("item", "doc", "score")
        best = _best(found, k, "item").select("item", F.col("rank").cast("int").alias("rank"), "doc", "score")
        out = best if out is None else out.unionByName(best)
    return out
