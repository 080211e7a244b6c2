r"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The fixed patterns (``base_spans``) find e-mail addresses, IP addresses, card numbers and phone
numbers.  These seed entities stand in contexts, and a context that mostly holds personal data
reveals identifiers that no fixed pattern knows.  Four steps:

1. ``mentions`` (one map): tokens of a text are runs without blanks and outer punctuation; a base
   span is one token.  Tokens that are base spans, or look like identifiers (a digit or ``@``, five
   bytes at least), are mentions.  Each has three lexical patterns: the two words before it, the
   word before and the word after, and the word before alone (letters in lower case, digits as 0).
   Staged, without texts.
2. Patterns that hold at least ``MIN_SEEDS`` different seed entities are induced.
3. ``fillers`` (a second map) counts, for the induced patterns, how often any other word fills
   them.  The map knows the patterns by a bitmap of fixed size; Spark adds up the few that pass and
   joins them exactly.
4. ``bootstrap``: the graph of patterns and instances is scored in rounds.  A pattern's confidence
   for a kind is the summed score of its mentions, over all its mentions and fillers plus ``PRIOR``;
   an instance's score for a kind is the noisy-or over its patterns of at least ``CONFIDENT``; seeds
   keep score 1 for their kind.  An instance of at least ``ACCEPT`` is an identifier, and all its
   mentions outside base spans become spans ``found_<kind>`` (the kind of highest score, ties by
   name).  New identifiers count for the patterns of the next round.

All sums are over (pattern, instance) pairs after map-side combine, so a context or an identifier
with a third of all mentions costs no task more.  Each round is staged.

Defined cases: a null text is an empty one, with no span and the digest of the empty string; a
very long text takes time in proportion to its length; repeated rows, and rows with a null or
repeated id, are scanned one by one; an empty table gives an empty result; extra columns are not
read.  Spans are code points with an exclusive end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.llm.common import staged

#: Kinds of the fixed patterns, in the order of the results.
KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, PRIOR, CONFIDENT, ACCEPT, ROUNDS = 3, 1.0, 0.5, 0.5, 3
MIN_BYTES = 5
#: Bits of the bitmap that the second map carries (512 KB).
SIEVE_BITS = 22

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(rb"[^0-9]+")
_GAP = re.compile(rb"[\x20\t\n]")

#: Bytes of a text as the patterns see them: lower case, digits as 0, these marks as blanks.
_MARKS = b" \t\n\x0b\x0c\r\"'`()[]{}<>,;!?*#$%&|"
_SEEN = bytes(32 if b in _MARKS else b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def luhn(digits: bytes) -> bool:
    doubled = sum(2 * (d - 48) - 9 * (d > 52) for d in digits[-2::-2])
    return (doubled + sum(d - 48 for d in digits[-1::-2])) % 10 == 0


def _emails(data: bytes) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from their @."""
    end, at = 0, data.find(b"@")
    while at >= 0:
        start = at
        while start > end and data[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(data, at + 1)):
            end = m.end()
            yield start, end
        at = data.find(b"@", max(at + 1, end))


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(data)]
    for m in _IP.finditer(data):
        if all(len(p) < 4 and int(p) < 256 for p in (x.lstrip(b"0") or b"0" for x in m[0].split(b"."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(data):
        digits = _OTHER.sub(b"", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if b"+" in data:
        out += [(3, *m.span()) for m in _PHONE.finditer(data) if 8 <= len(_OTHER.sub(b"", m[0])) <= 15]
    return out


def _token_piece(data: bytes, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    seen = np.frombuffer(data.translate(_SEEN), np.uint8)
    group = (seen != 32).astype(np.int32)  # 0 is a gap; a token ends where the value changes
    lost = []
    for k, (_, a, b) in sorted(enumerate(spans), key=lambda x: (x[1][1] - x[1][2], x[0])):
        if (group[a:b] > 1).any():
            lost.append((a, b))
        else:
            group[a:b] = k + 2
    edge = np.flatnonzero(np.diff(group, prepend=0, append=0))
    inside = group[edge[:-1]] != 0 if len(edge) else np.empty(0, bool)
    start, end = edge[:-1][inside], edge[1:][inside]
    span = group[start] - 2
    word = np.maximum.accumulate(np.where(seen != 46, np.arange(len(seen)), -1)) if len(seen) else seen
    end = np.where(span < 0, np.maximum(word[end - 1], start) + 1, end)  # full stops at the end are no part of the token
    length = end - start
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)  # place in the token
    power = np.full(int(length.max(initial=0)) + 1, _MIX, np.uint64)
    power = np.multiply.accumulate(power)
    value = (seen[np.repeat(start, length) + at].astype(np.uint64) + np.uint64(1)) * power[at]
    h = np.add.reduceat(value, np.cumsum(length) - length) if len(start) else np.empty(0, np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _STEP
    if spans:  # as a neighbour, a base span stands for its kind
        kinds = np.array([k + 1 for k, _, _ in spans], np.uint64)
        h = np.where(span >= 0, kinds[np.maximum(span, 0)] * _STEP, h)
    marks = np.append(0, np.cumsum((seen == 48) | (seen == 64)))
    like = (span < 0) & (length >= MIN_BYTES) & (marks[end] > marks[start])
    for a, b in lost:
        like &= (end <= a) | (start >= b)
    return start, end, h, span, like


def tokens(data: bytes, spans: list[tuple[int, int, int]], piece: int = 1 << 19) -> tuple[np.ndarray, ...]:
    """(start, end, hash, span, like) of the tokens: bytes from and to, the number of the base span
    that the token is (-1: none), and whether it looks like an identifier.  Where base spans overlap
    the longest is the token, of equals the first.  Long texts are worked in pieces, cut at a blank
    outside the spans (without one, after four pieces)."""
    out, at, inside = [], 0, sorted((a, b) for _, a, b in spans)
    while at < len(data):
        end = len(data)
        if end - at > 2 * piece:
            far = min(end, at + 4 * piece)
            gaps = (m.start() for m in _GAP.finditer(data, at + piece, far) if not any(a <= m.start() < b for a, b in inside))
            end = next(gaps, max([far, *(b for a, b in inside if a < far < b)]))
        mine = [k for k, (_, a, b) in enumerate(spans) if at <= a < end]
        start, stop, h, span, like = _token_piece(data[at:end], [(spans[k][0], spans[k][1] - at, spans[k][2] - at) for k in mine])
        number = np.append(np.array(mine, np.int64), -1)
        out.append((start + at, stop + at, h, number[span], like))
        at = end
    if not out:
        out = [_token_piece(b"", [])]
    return tuple(np.concatenate(x) for x in zip(*out))


def contexts(h: np.ndarray) -> np.ndarray:
    """The three patterns of every token, 0 where a neighbour is missing: (two before), (before,
    after), (before)."""
    n, out = len(h), np.zeros((3, len(h)), np.uint64)
    if n > 2:
        out[0, 2:] = (h[:-2] * _MIX + h[1:-1]) * _STEP + np.uint64(1)
        out[1, 1:-1] = (h[:-2] * _STEP + h[2:]) * _MIX + np.uint64(2)
    out[2, 1:] = h[:-1] * _MIX + np.uint64(3)
    return out


def _code_points(data: bytes, at: np.ndarray) -> np.ndarray:
    """Byte offsets as code points."""
    if data.isascii() or not len(at):
        return at
    begins = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))
    return begins[at]


def _instance(data: bytes, kind: int) -> int:
    """64-bit key of an identifier: letters in lower case; of cards and phones the digits alone."""
    plain = _OTHER.sub(b"", data) if kind >= 2 else data.lower()
    return xxhash.xxh64_intdigest(b"%d:" % kind + plain) - (1 << 63)


def describe(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(data: bytes) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans (kind, start, end) in code points, and the mentions."""
    spans = base_spans(data)
    start, end, h, span, like = tokens(data, spans)
    some = np.flatnonzero((span >= 0) | like)
    a, b = _code_points(data, start[some]), _code_points(data, end[some])
    ctx = contexts(h)[:, some].view(np.int64)
    found = []
    for n, j in enumerate(some.tolist()):
        kind = spans[span[j]][0] if span[j] >= 0 else -1
        found.append({"kind": kind, "start": int(a[n]), "end": int(b[n]), "instance": _instance(data[start[j]:end[j]], kind),
                      "patterns": [int(p) for p in ctx[:, n] if p]})
    if spans and not data.isascii():
        at = _code_points(data, np.array([x[1:] for x in spans]).ravel()).reshape(-1, 2).tolist()
        spans = [(k, x, y) for (k, _, _), (x, y) in zip(spans, at)]
    return spans, found


_MENTION = "array<struct<kind:int,start:long,end:long,instance:long,patterns:array<long>>>"


def mentions(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(row, id, n, base, mentions) per document: counts by kind, the base spans as text and the
    mentions; staged."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    schema = T.StructType([src.schema["row"], src.schema["id"], *T.StructType.fromDDL(f"n array<long>, base string, mentions {_MENTION}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["mentions"].dataType)
        for batch in batches:
            counts, base, found = [], [], []
            for x in batch.column(2).cast(pa.binary()):
                spans, some = scan(x.as_py() or b"")
                counts.append([sum(s[0] == k for s in spans) for k in range(len(KINDS))])
                base.append(describe([(KINDS[k], a, b) for k, a, b in spans]))
                found.append(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.string()),
                                              pa.array(found, kind)], names=["row", "id", "n", "base", "mentions"])

    return staged(src.mapInArrow(run, schema), "mentions")


def induced(graph: DataFrame, min_seeds: int) -> DataFrame:
    """(pattern): those with so many different seed entities."""
    seeds = graph.where("kind >= 0").select("pattern", "instance").distinct()
    return seeds.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_seeds).select("pattern")


def _sieve(patterns: DataFrame) -> np.ndarray:
    """Bitmap over the leading bits of the patterns; at most 2^16 rows come to the driver."""
    slot = F.shiftrightunsigned("pattern", 64 - SIEVE_BITS)
    words = patterns.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(pattern, {64 - SIEVE_BITS}) & 63 as int)))").alias("bits")).collect()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for w, bits in words:
        out[w] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def fillers(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, n): how often a word that is no mention fills each of the patterns."""
    sieve = np.packbits(_sieve(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(sieve).view(bool)
        for batch in batches:
            passed = [np.empty(0, np.uint64)]
            for x in batch.column(0).cast(pa.binary()):
                data = x.as_py() or b""
                _, _, h, span, like = tokens(data, base_spans(data))
                ctx = contexts(h)[:, (span < 0) & ~like].ravel()
                ctx = ctx[known[(ctx >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]]
                passed.append(ctx[ctx != 0])
            found, n = np.unique(np.concatenate(passed), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["pattern", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "pattern long, n long")
    return rows.groupBy("pattern").agg(F.sum("n").alias("n")).join(patterns, "pattern", "left_semi")


ONE = 1_000_000  # scores are whole millionths, so that sums do not depend on the order


def bootstrap(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(instance, kind, score) of the accepted identifiers and (pattern, kind, confidence) of the
    confident patterns of the last round.  ``edges``: (pattern, instance, kind or -1, n); ``totals``:
    (pattern, total)."""
    seeds = edges.where("kind >= 0").select("instance", "kind", F.lit(ONE).cast("long").alias("score")).distinct()
    unknown = edges.where("kind < 0").select("pattern", "instance")
    scores, accepted, patterns, before = seeds, None, None, -1
    for _ in range(rounds):
        mass = edges.select("pattern", "instance", "n").join(scores, "instance").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("mass")).join(totals, "pattern")
        part = F.expr("mass div total")
        patterns = staged(mass.select("pattern", "kind", part.alias("confidence")).where(part >= int(CONFIDENT * ONE)), "patterns")
        doubt = F.log(F.lit(1.0) - F.least("confidence", F.lit(ONE - 1)) / F.lit(float(ONE)))
        seen = unknown.join(patterns, "pattern").groupBy("instance", "kind").agg(F.sum(F.floor(doubt * -ONE)).alias("e"))
        score = F.floor((F.lit(1.0) - F.exp(-F.col("e") / F.lit(float(ONE)))) * ONE)
        best = seen.select("instance", score.alias("score"), "kind").where(F.col("score") >= int(ACCEPT * ONE))
        best = best.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        accepted = staged(best.select("instance", (-F.col("b.k")).alias("kind"), "b.score"), "accepted")
        now = accepted.count()
        if now == before or now == 0:
            break
        before, scores = now, seeds.unionByName(accepted)
    return accepted, patterns


def find_pii(docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_found, base, spans) per row of ``docs``; ``base`` and
    ``spans`` are ``kind:start:end``, joined by commas."""
    rows = mentions(docs, text, key)
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    graph = each.select("kind", "instance", F.explode("patterns").alias("pattern"))
    wanted = staged(induced(graph, min_seeds), "induced")
    edges = staged(graph.join(wanted, "pattern", "left_semi").groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("n")), "graph")
    both = edges.select("pattern", "n").unionByName(fillers(docs, text, wanted))
    totals = staged(both.groupBy("pattern").agg((F.sum("n") + int(PRIOR)).alias("total")), "totals")
    accepted, _ = bootstrap(edges, totals, rounds)
    names = F.array(*[F.lit(f"found_{k}") for k in KINDS])
    found = each.where("kind < 0").select("row", "start", "end", "instance").join(accepted.select("instance", "kind"), "instance")
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("f"))  # of one text
    more = F.transform("f", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    out = rows.select("row", "id", "n", "base").join(found, "row", "left")
    return out.select("id", *[F.get("n", i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("n_found"),
                      "base", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), more).alias("spans"))
