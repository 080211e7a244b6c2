"""Language identification by a convolutional network over bytes, in numpy.

Filters of widths 2, 3 and 4 run over the UTF-8 bytes of the lower-cased text, each with a
weight per byte value and offset; the maximum over a window, a rectifier and a softmax
layer follow.  A text is cut into windows of ``WINDOW`` bytes, all of which count: its
prediction is the mean of the windows' probabilities, weighted by their bytes.

The network is fitted on a bounded sample (``SAMPLE_DOCS`` documents of each language and
``SAMPLE_WINDOWS`` windows of each document, chosen by hash over all rows); every document
is predicted, in one map over Arrow batches without a shuffle.  At prediction two bytes
are looked up at once: a filter of width 4 is a sum of two entries of 65,536-row tables.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every
text if there is nothing to learn from; languages that are null are not learned; a null id
is not learned from and not held out; repeated rows are predicted one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 3
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 7
UNKNOWN = "und"


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))


def windows(data: bytes) -> np.ndarray:
    """All windows of the bytes, the last one filled with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteNet:
    """Weights: ``conv[w][k]`` (256 x filters) for offset k of width w, ``bias``, ``out`` and ``out_bias``."""

    def __init__(self, labels: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.conv = {w: [rng.normal(0, 0.1, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def params(self) -> list[np.ndarray]:
        return [t for w in WIDTHS for t in self.conv[w]] + [self.bias, self.out, self.out_bias]

    def _softmax(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross entropy; gradients reach a filter at the place of its maximum."""
        rng = np.random.default_rng(SEED)
        params = self.params()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                step += 1
                rows = order[lo:lo + BATCH]
                b, t = x[rows], y[rows]
                tops, places = [], []
                for w in WIDTHS:
                    n = WINDOW - w + 1
                    c = sum(self.conv[w][k][b[:, k:k + n]] for k in range(w))
                    at = c.argmax(1)
                    places.append(at)
                    tops.append(np.take_along_axis(c, at[:, None], 1)[:, 0])
                top = np.concatenate(tops, 1)
                hidden = np.maximum(top + self.bias, 0)
                p = self._softmax(top)
                p[np.arange(len(t)), t] -= 1
                p /= len(t)
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for j, w in enumerate(WIDTHS):
                    g = back[:, j * FILTERS:(j + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), g.shape)
                    for k in range(w):
                        d = np.zeros((256, FILTERS), np.float32)
                        np.add.at(d, (np.take_along_axis(b, places[j] + k, 1), f), g)
                        grads.append(d)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                for q, g, a, s in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    s += 0.001 * (g * g - s)
                    q -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums by byte pair: of offsets 0 and 1 of all widths, and of offsets 2 and 3 of widths 3 and 4."""
        c = self.conv
        first = [c[w][0][:, None] + c[w][1][None] for w in WIDTHS]
        third = np.broadcast_to(c[3][2][:, None], (256, 256, FILTERS))
        second = [third, c[4][2][:, None] + c[4][3][None]]
        flat = [np.concatenate(t, 2).reshape(1 << 16, -1).astype(np.float32) for t in (first, second)]
        return flat[0], flat[1]

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], block: int = 256) -> np.ndarray:
        """Softmax of every window (row of bytes)."""
        first, second = tables
        out = np.empty((len(x), len(self.labels)), np.float32)
        for lo in range(0, len(x), block):
            b = x[lo:lo + block].astype(np.int32)
            pair = b[:, :-1] * 256 + b[:, 1:]
            c = np.take(first, pair, axis=0)
            n2, n3, n4 = (WINDOW - w + 1 for w in WIDTHS)
            late = np.take(second, pair[:, 2:], axis=0)  # n4 places: both filters of widths 3 and 4
            top = np.empty((len(b), FILTERS * 3), np.float32)
            top[:, :FILTERS] = c[:, :n2, :FILTERS].max(1)
            c[:, :n4, FILTERS:] += late
            top[:, FILTERS:] = c[:, :n4, FILTERS:].max(1)
            end = c[:, n3 - 1, FILTERS:2 * FILTERS] + self.conv[3][2][b[:, -1]]  # width 3 fits once more
            top[:, FILTERS:2 * FILTERS] = np.maximum(top[:, FILTERS:2 * FILTERS], end)
            out[lo:lo + block] = self._softmax(top)
        return out


def training_windows(docs: DataFrame, text: str, key: str, label: str, n_docs: int, n_windows: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample of labelled windows, chosen by a hash of the id over all labelled rows."""
    usable = docs.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    counts = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}  # one row per language
    if not counts:
        return [], np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("lang:"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * n_docs / n))])
    some = usable.where(draw < share[F.col(label)]).select(draw.alias("draw"), F.col(label).cast("string").alias("lang"), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws, langs, parts = [], [], []
            for d, g, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                body = x.as_py()
                if any(map(str.isalpha, body)):
                    w = windows(body.lower().encode())
                    for k in sorted({int((i + 0.5) * len(w) / n_windows) for i in range(n_windows)}):
                        draws.append(d)
                        langs.append(g)
                        parts.append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(draws, pa.float64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())],
                                             names=["draw", "lang", "bytes"])

    rows = some.mapInArrow(run, "draw double, lang string, bytes binary").collect()
    taken: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["draw"], bytes(r["bytes"]))):
        if len(taken.setdefault(r["lang"], [])) < n_docs * n_windows:
            taken[r["lang"]].append(bytes(r["bytes"]))
    labels = sorted(taken)
    x = np.frombuffer(b"".join(b for g in labels for b in taken[g]), np.uint8).reshape(-1, WINDOW)
    return labels, x, np.repeat(np.arange(len(labels)), [len(taken[g]) for g in labels])


def train(docs: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "lang", n_docs: int = SAMPLE_DOCS,
          n_windows: int = SAMPLE_WINDOWS) -> ByteNet:
    labels, x, y = training_windows(docs, text, key, label, n_docs, n_windows)
    net = ByteNet(labels)
    if len(x):
        net.fit(x, y)
    return net


def predict(docs: DataFrame, net: ByteNet, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) per row of ``docs``."""
    src = docs.select(docs[key], held_out(docs[key]).alias("_held"), docs[text].alias("_text"))
    schema = T.StructType([src.schema[0], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pair_tables()
        for batch in batches:
            names, scores = [], []
            for x in batch.column(2):
                body = x.as_py()
                if not net.labels or body is None or not any(map(str.isalpha, body)):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                data = body.lower().encode()
                w = windows(data)
                weight = np.full(len(w), float(WINDOW))
                weight[-1] = len(data) - WINDOW * (len(w) - 1)
                p = weight @ net.probabilities(w, tables) / len(data)
                best = int(p.argmax())
                names.append(net.labels[best])
                scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=schema.names)

    return src.mapInArrow(run, schema)
