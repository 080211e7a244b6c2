r"""Secret scan: fixed patterns plus sliding-window Shannon entropy.

One map over Arrow batches, no shuffle; whole texts are scanned, offsets are code
points with an exclusive end.

* ``assign``, ``access`` and ``hex`` are pattern spans (see ``base_spans``).
* ``entropy`` spans come from candidate strings: maximal runs of one character class
  (hexadecimal digits, else base64 characters) of at least the window of that class.
  A window slides over the candidate; its entropy is kept by incremental character
  counts (one character enters, one leaves, two terms change).  The span is the union
  of adjacent windows at or above the class threshold.  A base64 window has the threshold
  of the alphabet that its own characters show: digits and letters of one case (base 32
  and 36), or any other.  Spans of both classes that meet are one.
* A run is cut after ``=`` before other characters (``name=value``; in base64 it only ends
  a value), and hexadecimal runs end at any character but letters and digits, so a
  neighbour does not change the class.  ``/``, ``_`` and ``-`` belong to base64 and do not cut.
* The allow-list suppresses entropy windows only: placeholders, UUIDs and alphabet
  sequences are no secrets.  A listed word stands for the run of letters and digits
  that holds it, and the windows that overlap it are dropped.  Pattern spans always stay.

Defined cases: null and empty texts give no span and the digest of the empty string;
a very long text costs time in proportion to its length; repeated rows are scanned one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more: the run after AKIA is maximal either way
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

#: class name -> (characters, window, bits per character that a window must reach)
CLASSES = {
    "hex": (re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])"), 20, 3.0),
    "base64": (re.compile(r"(?:[A-Za-z0-9+/_-]|=(?![A-Za-z0-9+/_-])){24,}"), 24, 3.9),
}
#: Bits for a base64 window of digits and letters of one case: 32 to 36 characters instead of 64.
ONE_CASE_BITS = 3.75
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
ALLOWED = ("example", "placeholder", "changeme", "dummy", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "deadbeef")
_WORD = re.compile("[0-9A-Za-z]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Pattern spans, leftmost and non-overlapping per kind; failing matches are dropped
    after they have consumed their text."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def hot_windows(run: str, width: int, bits: float, one_case: float | None = None,
                barred: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Unions of the windows of ``run`` with at least ``bits`` of Shannon entropy (``one_case``
    where a window has digits and no letters of both cases) that overlap nothing
    ``barred``, by incremental counts:
    H = log2(width) - sum(c * log2(c)) / width."""
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]  # one enters before one leaves
    count: dict[str, int] = {}
    total, out = 0.0, []
    upper = lower = digit = bar = -1  # places of the last of each kind
    closed = {i for a, b in barred for i in range(a, b)}
    for i, ch in enumerate(run):
        if i in closed:
            bar = i
        if "A" <= ch <= "Z":
            upper = i
        elif "a" <= ch <= "z":
            lower = i
        elif "0" <= ch <= "9":
            digit = i
        c = count.get(ch, 0)
        total += term[c + 1] - term[c]
        count[ch] = c + 1
        if i >= width:
            gone = run[i - width]
            c = count[gone]
            total += term[c - 1] - term[c]
            count[gone] = c - 1
        lo = i - width + 1
        need = bits if one_case is None or digit < lo or min(upper, lower) >= lo else one_case
        if lo > bar and lo >= 0 and math.log2(width) - total / width >= need - 1e-9:
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((lo, i + 1))
    return out


def allowed(run: str) -> list[tuple[int, int]]:
    """The words of ``run`` that the allow-list excuses, and its UUIDs."""
    low = run.lower()
    out = [m.span() for m in UUID.finditer(run)]
    if any(a in low for a in ALLOWED):
        out += [m.span() for m in _WORD.finditer(run) if any(a in low[m.start():m.end()] for a in ALLOWED)]
    return out


def entropy_spans(text: str) -> list[Span]:
    found: list[tuple[int, int]] = []
    for name, (pattern, width, bits) in CLASSES.items():
        for m in pattern.finditer(text):
            run = m.group()
            hot = hot_windows(run, width, bits, ONE_CASE_BITS if name == "base64" else None, allowed(run))
            found += [(m.start() + a, m.start() + b) for a, b in hot]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [("entropy", a, b) for a, b in out]


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """(pattern spans, all spans), each in order of start and kind."""
    text = text or ""
    base = base_spans(text)
    return _ordered(base), _ordered(base + entropy_spans(text))


def find_secrets(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the key, counts per kind, digest of the pattern spans
    and all spans as text and as an array of structs (kind, start, end)."""
    src = docs.select(docs[key], docs[text].alias("_text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_entropy")]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
               T.StructField("found", span)]
    schema = T.StructType([src.schema[0], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in fields}
            for x in batch.column(1).to_pylist():
                base, spans = scan_text(x)
                for kind in KINDS:
                    rows[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["spans"].append(_joined(spans))
                rows["found"].append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            arrays = [batch.column(0)] + [pa.array(rows[n], t) for n, t in (
                ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_entropy", pa.int64()),
                ("base_sha256", pa.string()), ("spans", pa.string()),
                ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *(f.name for f in fields)])

    return src.mapInArrow(run, schema)
