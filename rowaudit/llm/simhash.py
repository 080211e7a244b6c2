"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: ASCII-lower-cased words, shingles of three, XXH64 with seed 42 per
shingle; a bit is 1 if it is set in over half the shingles.  This is one map over Arrow
batches; equal fingerprints are then merged, so copies cost nothing below.

Search for pairs of distinct fingerprints at most ``max_bits`` (tau) apart:

1. the correlation of every two bits is counted over all distinct fingerprints, and
   correlated bits are grouped into m partitions, for each m tried;
2. partition i gets a threshold tau_i >= -1 (-1: not probed) with
   sum(tau_i + 1) = tau + 1: two fingerprints within tau agree up to tau_i in at least
   one probed partition.  Dynamic programming picks m and the thresholds of least cost:
   probes (a ball of radius tau_i per fingerprint) plus estimated candidates.  The
   candidates at threshold 0 are counted over all fingerprints; larger thresholds scale
   that by the ratio of the independent-bit model;
3. every fingerprint is filed under its projections and probes the ball around them;
   candidates are verified by their bit distance.

A partition value shared by more than ``DENSE`` fingerprints (a cluster of near copies)
would give pairs by the square.  Its members are linked by another exact way: two
fingerprints are within two bits if and only if some value lies within one bit of both.
Each member emits that ball of 65 values, and the at most 65 distinct fingerprints that
share one are linked to its smallest; no link is lost, and the cost is linear.  (For
other tau the balls have radius tau // 2 and their members are compared, see ``_dense``.)

Defined cases: null and blank texts have fingerprint zero and are linked like any other;
a null id never becomes a component id unless the whole component has none (then null);
repeated rows stay, with equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.llm.common import fresh, staged
from rowaudit.llm.components import connected

BITS, SEED = 64, 42
SHINGLE, MAX_BITS = 3, 2
#: Partition values with more fingerprints than this are linked by balls instead of pairs.
DENSE = 64
PARTITIONS = (2, 3, 4)
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint as an unsigned int."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    ends = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, _CHUNK):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b - 1], SEED)
                      for a, b in zip(starts[lo:min(lo + _CHUNK, n)], ends[lo:lo + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, tie, fp) per row: tie is a hash of the text, fp the fingerprint as a signed long."""
    src = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("tie"), docs[text].alias("body"))
    schema = T.StructType([src.schema[0], src.schema[1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())],
                                             names=["id", "tie", "fp"])

    return src.mapInArrow(run, schema)


# ------------------------------------------------------------------ plan
def bit_agreement(reps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, matrix of sums of s_i * s_j with s = +1 or -1; diagonal: sum of s_i)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype("<i8")
            for lo in range(0, len(fp), _CHUNK):
                raw = np.unpackbits(np.ascontiguousarray(fp[lo:lo + _CHUNK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                s = raw.astype(np.float32) * 2 - 1
                part = np.rint(s.T @ s).astype(np.int64)
                np.fill_diagonal(part, np.rint(s.sum(0)).astype(np.int64))
                total += part
                n += len(s)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()),
             pa.array(np.append(total[i, j], n), pa.int64())], names=["i", "j", "s"])

    rows = reps.select("fp").mapInArrow(run, "i int, j int, s long").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m, n = np.zeros((BITS, BITS)), 0
    for r in rows:  # 2,081 rows
        if r["i"] < 0:
            n = r["s"]
        else:
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    return n, m


def group_bits(n: int, sums: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal number; each starts with the most correlated free
    pair and takes the bit of the largest mean correlation with it, again and again."""
    mean = np.diag(sums) / max(n, 1)
    cov = sums / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(1 - mean ** 2, 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        if k == m - 1:
            out.append(sorted(free))
            break
        f = sorted(free)
        sub = corr[np.ix_(f, f)]
        a, b = np.unravel_index(int(sub.argmax()), sub.shape)
        group = [f[a], f[b]] if a != b else f[:2]
        while len(group) < width:
            left = sorted(free - set(group))
            group.append(left[int(corr[np.ix_(left, group)].mean(1).argmax())])
        out.append(sorted(group))
        free -= set(group)
    return out


def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bit changes of one value."""
    size, term = 0, 1
    for r in range(radius + 1):
        size += term
        term = term * (width - r) // (r + 1)
    return size


def ratios(agree: np.ndarray, tau: int) -> list[float]:
    """P(distance <= t) / P(distance = 0) for independent bits with these chances to agree."""
    p = np.zeros(tau + 1)
    p[0] = 1.0
    for a in np.clip(agree, 1e-6, 1):
        p[1:] = p[1:] + p[:-1] * (1 - a) / a
    return list(np.cumsum(p))


def allocate(cost: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds (-1 .. tau) with sum(tau_i + 1) = tau + 1 of least total cost;
    ``cost[i][t + 1]`` is that of partition i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, picks) in best.items():
            for t in range(-1, tau - used + 1):
                got = (total + c[t + 1], [*picks, t])
                if used + t + 1 not in step or got < step[used + t + 1]:
                    step[used + t + 1] = got
        best = step
    return best[tau + 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def choose_plan(reps: DataFrame, tau: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """[(bits of the partition, threshold)] of the partitions to probe."""
    n, sums = bit_agreement(reps)
    if n < 2:
        return [(list(range(BITS)), tau)] if tau == 0 else [(list(range(b, BITS, tau + 1)), 0) for b in range(tau + 1)]
    agree = (1 + (np.diag(sums) / n) ** 2) / 2
    tried = [group_bits(n, sums, m) for m in PARTITIONS]
    flat = [g for groups in tried for g in groups]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key"))
                               for i, g in enumerate(flat)])).alias("k")
    same = reps.select(keys).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    pairs = {r["part"]: float(r["p"]) for r in
             same.groupBy("k.part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("p")).collect()}
    best, at = None, 0
    for groups in tried:
        cost = []
        for g in groups:
            grow = ratios(agree[g], tau)
            cost.append([0.0] + [n * ball(len(g), t) + pairs.get(at, 0.0) * grow[t] for t in range(tau + 1)])
            at += 1
        total, picks = allocate(cost, tau)
        if best is None or total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, picks) if t >= 0])
    return best[1]


# ---------------------------------------------------------------- search
def _flips(value: Column, bits: list[int], radius: int) -> Column:
    """Array of all values within ``radius`` changes among ``bits``."""
    masks = [0] + [_mask(c) for r in range(1, radius + 1) for c in combinations(bits, r)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def _near(x: str, y: str, tau: int) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= tau


def _dense(members: DataFrame, tau: int) -> DataFrame:
    """Links among ``members`` (fp) that keep their components, by balls of half the distance.
    Members of a ball of radius tau // 2 are within 2 * (tau // 2) of each other; for an odd
    tau the remaining pairs meet at a ball around one of them, so that side uses the larger radius."""
    bits = list(range(BITS))
    if tau % 2 == 0:
        rows = members.select("fp", F.explode(_flips(F.col("fp"), bits, tau // 2)).alias("c"))
        least = rows.groupBy("c").agg(F.collect_set("fp").alias("f")).where(F.size("f") > 1)  # at most one ball of values
        return least.select(F.array_min("f").alias("a"), F.explode("f").alias("b")).where("a < b").distinct()
    outer = members.select(F.col("fp").alias("b"), F.explode(_flips(F.col("fp"), bits, tau // 2 + 1)).alias("c"))
    inner = members.select(F.col("fp").alias("a"), F.explode(_flips(F.col("fp"), bits, tau // 2)).alias("c"))
    return inner.join(outer, "c").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(reps: DataFrame, tau: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most ``tau`` bits apart.
    All links outside dense partition values; inside these, links with the same components."""
    plan = choose_plan(reps, tau)
    filed = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key"))
                      for i, (g, _) in enumerate(plan)])
    probe = F.concat(*[F.transform(_flips(F.col("fp").bitwiseAND(F.lit(_mask(g))), g, t),
                                   lambda k, i=i: F.struct(F.lit(i).alias("part"), k.alias("key")))
                       for i, (g, t) in enumerate(plan)])
    index = reps.select("fp", F.explode(filed).alias("k")).select("fp", "k.part", "k.key")
    probes = index if all(t == 0 for _, t in plan) else reps.select("fp", F.explode(probe).alias("k")).select("fp", "k.part", "k.key")
    # a probe meets nobody unless its value has a member that is not itself
    sizes = probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = staged(sizes, "values")
    few = sizes.where(F.col("n") <= dense).select("part", "key")
    a = index.join(few, ["part", "key"]).select("part", "key", F.col("fp").alias("a"))
    b = probes.join(few, ["part", "key"]).select("part", "key", F.col("fp").alias("b"))
    links = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & _near("a", "b", tau)).select("a", "b")
    many = sizes.where(F.col("n") > dense).select("part", "key")
    crowd = probes.join(many, ["part", "key"], "left_semi").select("fp").distinct()
    return links.unionByName(_dense(crowd, tau))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """One row per row of ``docs``: id, tie, fp, root (smallest fingerprint of the component)
    and component (smallest id of the component)."""
    fps = staged(fingerprints(docs, text=text, key=key, shingle=shingle), "fingerprints")
    reps = staged(fps.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fp")
    roots = connected(near_links(reps.select("fp"), max_bits, dense))
    linked = reps.join(roots, reps["fp"] == roots["node"])
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.select("fp", "root").join(least, "root")
    alone = reps.join(roots, reps["fp"] == roots["node"], "left_anti").select(
        "fp", F.col("fp").alias("root"), F.col("first").alias("component"))
    classes = linked.select("fp", "root", "component").unionByName(alone)
    return fps.join(staged(classes, "classes"), "fp", "left")


def keep_one(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: per component the row of smallest id (null last, then
    by text hash); of rows equal in id and text, one."""
    found = near_duplicates(docs, text=text, key=key, shingle=shingle, max_bits=max_bits)
    pick = F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("tie").alias("tie"))).alias("p")
    kept = found.groupBy("root").agg(pick).select(F.col("p.id").alias("id"), F.col("p.tie").alias("tie"))
    kept = staged(kept, "kept")
    again = found.groupBy("id", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    t, i2, t2 = fresh(docs, "_st", "_si2", "_st2")
    tied = docs.withColumn(t, F.xxhash64(text))
    kept = kept.select(F.col("id").alias(i2), F.col("tie").alias(t2))
    out = tied.join(kept, F.col(key).eqNullSafe(F.col(i2)) & (F.col(t) == F.col(t2)), "left_semi")
    return (out.dropDuplicates([key, t]) if again else out).drop(t)
