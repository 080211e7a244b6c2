"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased and split into runs of letters, digits and underscores; in scripts without
spaces (Han, kana, Thai and others) each letter is a token.  Every run
of ``min_match`` tokens gets a Karp-Rabin hash; those of the benchmark are the seeds.  A
document's rolling hashes are looked up among the seeds, and every (document, item) pair
that shares one is tiled: of the maximal common runs of unmarked tokens the longest is
marked as a tile, again and again, until none has ``min_match`` tokens; then the tokens left
over are tiled in the same way down to ``MIN_TILE`` tokens, no further from a seed than the
item is long (so common word pairs elsewhere in a long document do not count).  Tiles do not
overlap, and they may be in any order, so a passage whose sentences were rearranged, short
ones too, is covered as well.  A pair counts if its tiles cover at least ``coverage`` of the
item.  An item with fewer than ``min_match`` tokens is a seed as a whole.

The documents are read once per block of benchmark items, in one map without a shuffle.
A block holds at most ``BLOCK_TOKENS`` tokens (about 32 MB of seeds); a larger benchmark
is worked in more blocks.  Documents never meet in one task or on the driver.

Defined cases: null and empty texts match nothing; items with fewer than ``MIN_TILE``
tokens match nothing; very long texts are hashed in pieces of 1 MB; repeated rows give
repeated results; items that are repeated give one row each; empty tables give empty
results (and documents without a benchmark are all clean).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_MATCH, MIN_TILE, COVERAGE = 5, 2, 0.8
BLOCK_TOKENS = 1_000_000
_PIECE = 1 << 20
_WORD_BASE, _GRAM_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GAP = re.compile(r"\W+")


#: Letters of scripts without spaces, each a token of its own: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_DENSE = re.compile("([\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                    "\uff66-\uff9f\U00020000-\U0003ffff])")


def normal(text: str | None) -> bytes:
    """Lower-case tokens with single spaces between them."""
    plain = _GAP.sub(" ", (text or "").lower())
    if not plain.isascii() and _DENSE.search(plain):
        plain = " ".join(_DENSE.sub(r" \1 ", plain).split())
    return plain.strip().encode()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Hasher:
    """Hashes of the space-separated tokens of byte strings, many at once."""

    def __init__(self) -> None:
        inverse = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))
        self.up, self.down = _powers(_WORD_BASE, 1 << 16), _powers(inverse, 1 << 16)
        self.inverse = inverse

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(_WORD_BASE, n), _powers(self.inverse, n)

    def tokens(self, data: bytes) -> np.ndarray:
        """One uint64 per token of ``data``."""
        if len(data) > 2 * _PIECE:  # tokens are hashed alone: any space is a place to cut
            out, at = [], 0
            while at < len(data):
                end = data.find(b" ", at + _PIECE)
                end = len(data) if end < 0 else end
                out.append(self._one(data[at:end]))
                at = end + 1
            return np.concatenate(out)
        return self._one(data)

    def _one(self, data: bytes) -> np.ndarray:
        if not data:
            return np.empty(0, np.uint64)
        self._grow(len(data) + 1)
        a = np.frombuffer(data, np.uint8)
        gap = np.flatnonzero(a == 32)
        start, end = np.append(0, gap + 1), np.append(gap, len(a))
        keep = end > start
        start, end = start[keep], end[keep]
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[:len(a)], out=total[1:])
        h = (total[end] - total[start]) * self.down[start]
        return (h ^ (h >> np.uint64(29))) * _GRAM_BASE


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``width`` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = tokens[:n].copy()
    for j in range(1, width):
        h = h * _WORD_BASE + tokens[j:j + n]
    return h


#: Seed hits that are held at once while runs are put together.
_HITS = 1 << 20


def common_runs(places: np.ndarray, grams: np.ndarray, items: np.ndarray, item_grams: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """The maximal runs of common tokens as (document position, item position, length), from the
    grams of ``width`` tokens at ``places`` of the document (ascending) and at ``items`` of the item
    (``item_grams`` ascending).  Hits are worked in blocks of document positions and joined along
    their diagonals, so what is held is a row per run and not per hit."""
    lo, hi = np.searchsorted(item_grams, grams, "left"), np.searchsorted(item_grams, grams, "right")
    some = hi > lo
    places, lo, many = places[some], lo[some], (hi - lo)[some]
    ends = np.cumsum(many)
    parts, at = [], 0
    while at < len(places):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _HITS, "right")))
        n = many[at:end]
        d = np.repeat(places[at:end], n)
        i = items[np.repeat(lo[at:end] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.lexsort((d, d - i))
        d, diagonal = d[order], (d - i)[order]
        new = np.append(True, (np.diff(diagonal) != 0) | (np.diff(d) > 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1
        parts.append(np.stack([diagonal[first], d[first], d[last]]))
        at = end
    if not parts:
        return []
    diagonal, first, last = np.concatenate(parts, axis=1)
    order = np.lexsort((first, diagonal))  # runs that go on in the next block are one
    diagonal, first, last = diagonal[order], first[order], last[order]
    new = np.flatnonzero(np.append(True, (np.diff(diagonal) != 0) | (first[1:] > last[:-1] + 1)))
    stop = np.append(new[1:], len(first)) - 1
    d, n = first[new], last[stop] - first[new] + width
    return list(zip(d.tolist(), (d - diagonal[new]).tolist(), n.tolist()))


def tile(runs: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the maximal runs: tiles as (document position, item position, length),
    longest first, ties by position."""
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while runs:
        runs.sort(key=lambda r: (-r[2], r[0], r[1]))
        d, i, n = runs[0]
        tiles.append((d, i, n))
        in_doc.update(range(d, d + n))
        in_item.update(range(i, i + n))
        rest = []
        for d2, i2, n2 in runs[1:]:  # cut the other runs at marked tokens
            if i <= i2 and i2 + n2 <= i + n or d <= d2 and d2 + n2 <= d + n:
                continue
            if d2 + n2 <= d or d2 >= d + n:
                if i2 + n2 <= i or i2 >= i + n:
                    rest.append((d2, i2, n2))
                    continue
            begin = None
            for k in range(n2 + 1):
                free = k < n2 and d2 + k not in in_doc and i2 + k not in in_item
                if free and begin is None:
                    begin = k
                elif not free and begin is not None:
                    if k - begin >= width:
                        rest.append((d2 + begin, i2 + begin, k - begin))
                    begin = None
        runs = rest
    return tiles


class Seeds:
    """The runs of ``width`` tokens of many items, sorted by hash, with their item."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int) -> None:
        self.width = width
        grams = [rolling(t, width) for _, t in items]
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        self.grams = g[order]
        self.owner = np.concatenate([np.full(len(x), i, np.int32) for (i, _), x in zip(items, grams)])[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def found(self, tokens: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """(document positions, grams there) of the common runs, by item."""
        g = rolling(tokens, self.width)
        at = np.flatnonzero(self.sieve[(g >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(self.grams, g[at], "left")
        hi = np.searchsorted(self.grams, g[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        by_item: dict[int, list[int]] = {}
        for a, b in sorted(set(zip(lo.tolist(), hi.tolist()))):  # of each distinct gram, the items that hold it
            for item in set(self.owner[a:b].tolist()):
                by_item.setdefault(item, []).append(a)
        out = {}
        for item, starts in by_item.items():
            mine = at[np.isin(lo, starts)]
            out[item] = (mine, g[mine])
        return out


class Matcher:
    """The seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple], min_match: int, coverage: float) -> None:
        self.coverage, self.hasher = coverage, Hasher()
        self.ids = [i for i, _ in items]
        self.tokens = [self.hasher.tokens(normal(text)) for _, text in items]
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, t in enumerate(self.tokens):
            if len(t) >= min(MIN_TILE, min_match):
                by_width.setdefault(min(min_match, len(t)), []).append((i, t))
        self.seeds = [Seeds(some, width) for width, some in sorted(by_width.items())]

    def _tiles(self, doc: np.ndarray, item: np.ndarray, at: np.ndarray, grams: np.ndarray, width: int) -> list[tuple[int, int, int]]:
        """The tiles of a pair from the document's seed positions, or none if they cannot cover enough."""
        n, need = len(item), self.coverage * len(item) - 1e-9
        short = min(MIN_TILE, width)
        near = np.zeros(len(doc) + 1, np.int64)  # document tokens no further from a seed than the item is long
        np.add.at(near, np.maximum(at - n, 0), 1)
        np.add.at(near, np.minimum(at + width + n, len(doc)), -1)
        brief = rolling(doc, short)
        close = np.flatnonzero(np.cumsum(near)[:len(brief)] > 0)
        mine = rolling(item, short)
        found = np.flatnonzero(np.isin(mine, brief[close]))
        reach = np.zeros(n, bool)  # no tiling covers more than these
        for k in range(short):
            reach[found + k] = True
        if reach.sum() < need:
            return []
        whole = rolling(item, width)
        order = np.argsort(whole, kind="stable")
        tiles = tile(common_runs(at, grams, order, whole[order], width), width)
        free_doc, free_item = np.ones(len(doc), bool), np.ones(n, bool)
        for d, i, k in tiles:
            free_doc[d:d + k] = free_item[i:i + k] = False
        close = close[np.all([free_doc[close + k] for k in range(short)], axis=0)]
        found = found[np.all([free_item[found + k] for k in range(short)], axis=0)]
        found = found[np.argsort(mine[found], kind="stable")]
        tiles += tile(common_runs(close, brief[close], found, mine[found], short), short)
        return tiles if sum(k for _, _, k in tiles) >= need else []

    def match(self, text: str | None) -> list[tuple]:
        """(item id, item tokens, covered tokens, tiles) of the items that the text covers."""
        doc = self.hasher.tokens(normal(text))
        seeds = {i: (*hit, s.width) for s in self.seeds for i, hit in s.found(doc).items()}
        out = []
        for item, (at, grams, width) in sorted(seeds.items()):
            if tiles := self._tiles(doc, self.tokens[item], at, grams, width):
                out.append((self.ids[item], len(self.tokens[item]), sum(k for _, _, k in tiles), tiles))
        return out


def blocks(benchmark: DataFrame, text: str, key: str, size: int = BLOCK_TOKENS) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of about ``size`` tokens each (at least one)."""
    spaces = F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1
    total = benchmark.agg(F.sum(spaces)).first()[0] or 0
    n = max(1, -(-int(total) // size))
    part = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n))
    for i in range(n):
        rows = benchmark.where(part == i).select(key, text).where(F.col(text).isNotNull()).orderBy(key, text)
        yield [(r[0], r[1]) for r in rows.collect()]  # one block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text",
               item_key: str = "item_id", min_match: int = MIN_MATCH, coverage: float = COVERAGE,
               block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document and item that it covers: key, item, n_tokens of the item, covered,
    share, and tiles (document token, item token, length)."""
    src = docs.select(docs[key], docs[text].alias("_text"))
    item = T.StructField(item_key, benchmark.schema[item_key].dataType)
    tile_type = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_token", "item_token", "length")])
    schema = T.StructType([src.schema[0], item, T.StructField("n_tokens", T.LongType()), T.StructField("covered", T.LongType()),
                           T.StructField("share", T.DoubleType()), T.StructField("tiles", T.ArrayType(tile_type))])
    out = None
    for rows in blocks(benchmark, item_text, item_key, block_tokens):
        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            m = Matcher(rows, min_match, coverage)
            for batch in batches:
                at, found = [], []
                for n, x in enumerate(batch.column(1)):
                    for f in m.match(x.as_py()):
                        at.append(n)
                        found.append(f)
                tiles = [[{"doc_token": d, "item_token": i, "length": k} for d, i, k in f[3]] for f in found]
                arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array([f[0] for f in found], to_arrow_type(item.dataType)),
                          pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                          pa.array([f[2] / f[1] for f in found], pa.float64()),
                          pa.array(tiles, pa.list_(pa.struct([(c, pa.int64()) for c in ("doc_token", "item_token", "length")])))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_key: str = "item_id",
               min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item, all columns unchanged; no shuffle."""
    at = docs.columns.index(text)
    out = docs
    for rows in blocks(benchmark, item_text, item_key, block_tokens):
        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            m = Matcher(rows, min_match, coverage)
            for batch in batches:
                yield batch.filter(pa.array([not m.match(x.as_py()) for x in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
