"""K-d tree sharding: split at weighted medians along the widest metadata dimension until
the leaves reach the target bytes.

The tree is built over metadata alone (one staged row of numbers per document).  Every
level splits all its nodes at once: one aggregate gives the extent of each dimension per
node, the widest one (relative to the whole table) is chosen, and the weighted quantile
that divides the bytes as the leaves are to be divided (a median for an even number) is
found by histogram refinement: bytes per (node, bin) are summed with map-side combine, a
running sum over at most 16,384 bins per node finds the bin that holds the cut, and that
bin is split again between the least and the greatest position in it, until it is light or
holds one position.  Only one row per node reaches the driver; no task sorts the table.

Texts (source, language, ids that are no numbers) are dimensions by the rank of their distinct
values.  Positions along a dimension are 63-bit integers: 20 bits of the scaled value, 31 bits of
a hash of id and text, 12 bits that tell equal rows apart.  So a value that holds a third of
all rows, or thousands of equal rows, is divided as finely as any other.

Slots number the documents of a shard from 0 without gaps, in id order inside hash
buckets: counts per (shard, bucket) become offsets, a window numbers inside the bucket.

Defined cases: null text has 8 bytes and checksum 0; null metadata lies below all values;
an empty table gives an empty result; equal rows get slots of their own.  More shards than
documents leave some shards empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowaudit.llm.common import fresh, staged
from rowaudit.operators.clean import ranked_sorted

ROW_BYTES = 8
KEY_BITS, VALUE_BITS, BIN_BITS = 63, 20, 14
#: A cut may leave this share of one leaf's bytes on the wrong side.
TOLERANCE = 0.002
BUCKET_ROWS = 50_000
_STATE = "node long, dim int, lo long, bits int, need double"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def text_bytes(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_BYTES).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit(""))).cast("long")


def dimensions(docs: DataFrame, text: str, key: str) -> dict[str, Column]:
    """What documents are told apart by: size, source, language, id; numbers or texts.
    Columns that ``docs`` lacks are left out."""
    dims = {"size": F.log(text_bytes(F.col(text)).cast("double"))}
    dims |= {c: F.col(c).cast("string") for c in ("source", "lang") if c in docs.columns}
    numeric = isinstance(docs.schema[key].dataType, T.NumericType)
    return dims | {"id": F.coalesce(F.col(key).cast("double"), F.lit(-1.0)) if numeric else F.col(key).cast("string")}


def value_ranks(meta: DataFrame) -> dict[str, DataFrame]:
    """For each text dimension ``s<i>`` the rank of its distinct values from 0, as (s<i>, d<i>): a
    range partitioning with offsets, so no task sorts them all."""
    return {c: staged(ranked_sorted(meta.where(F.col(c).isNotNull()).select(c).distinct(), c, "_rank").select(
        c, (F.col("_rank") - 1).cast("double").alias("d" + c[1:])), "ranks") for c in meta.columns if c[0] == "s" and c[1:].isdigit()}


def with_ranks(rows: DataFrame, ranks: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with the rank in place of each text dimension; null lies below all."""
    for c, table in ranks.items():
        d = "d" + c[1:]
        rows = rows.join(table, c, "left").drop(c).withColumn(d, F.coalesce(d, F.lit(-1.0)))
    return rows


def _positions(low: list[float], high: list[float]) -> dict[str, Column]:
    """k<i>: the row's position along dimension i, from d<i>, id, crc and mid."""
    fine = F.shiftleft(F.shiftrightunsigned(F.xxhash64("id", "crc"), 33), 12).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64("mid"), 52))
    out = {}
    for i, (a, b) in enumerate(zip(low, high)):
        q = F.floor((F.col(f"d{i}") - F.lit(a)) / F.lit((b - a) or 1.0) * F.lit(float((1 << VALUE_BITS) - 1))).cast("long")
        out[f"k{i}"] = F.shiftleft(q, KEY_BITS - VALUE_BITS).bitwiseOR(fine)
    return out


def _at(df: DataFrame, n_dims: int) -> Column:
    """The row's position along the dimension of its node (column dim)."""
    return F.element_at(F.array(*[F.col(f"k{i}") for i in range(n_dims)]), F.col("dim") + 1)


def _joined(rows: DataFrame, table: list[tuple], schema: str, how: str) -> DataFrame:
    """``rows`` with the entry of their node; ``table`` has at most one entry per shard."""
    names = [c.split()[0] for c in schema.split(", ")]
    if len(table) > 1:
        kinds = [_ARROW[c.split()[1]] for c in schema.split(", ")]
        local = pa.table([pa.array(v, t) for v, t in zip(zip(*table), kinds)], names=names)
        return rows.join(F.broadcast(rows.sparkSession.createDataFrame(local)), "node", how)
    mine = F.col("node") == table[0][0]
    rows = rows.where(mine) if how == "inner" else rows
    kinds = [c.split()[1] for c in schema.split(", ")]
    return rows.withColumns({n: F.when(mine, F.lit(v).cast(t)) for n, v, t in zip(names[1:], table[0][1:], kinds[1:])})


def _cuts(rows: DataFrame, state: list[tuple], n_dims: int, tolerance: float) -> dict[int, int]:
    """Cut position per node: rows below it weigh as near ``need`` as the tolerance asks.
    state: (node, dim, lo, bits, need), the positions lo .. lo + 2^bits - 1 that hold the cut."""
    cuts = {}
    while state:
        at = _joined(rows, state, _STATE, "inner").withColumn("_at", _at(rows, n_dims))
        inside = at.where("_at >= lo and shiftright(_at - lo, bits) = 0")
        bins = inside.withColumn("bin", F.expr(f"shiftright(_at - lo, greatest(bits - {BIN_BITS}, 0))"))
        hist = bins.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.max("need").alias("need"),
                                               F.min("_at").alias("first"), F.max("_at").alias("last"))
        run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy("node")
        hist = hist.withColumn("upto", F.sum("w").over(run)).withColumn("end", F.max("bin").over(whole))
        hit = hist.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("w") < F.col("need"))
                         | (F.col("bin") == F.col("end")) & (F.col("upto") < F.col("need")))
        found = {r["node"]: r for r in hit.collect()}  # one row per open node
        nxt = []
        for node, dim, lo, _, need in state:
            r = found.get(node)
            if r is None:  # nothing to divide
                cuts[node] = lo
                continue
            rest = need - (r["upto"] - r["w"])
            if r["w"] <= tolerance or r["first"] == r["last"]:
                cuts[node] = r["first"] if rest < r["w"] / 2 else r["last"] + 1
            else:
                nxt.append((node, dim, r["first"], (r["last"] - r["first"]).bit_length(), rest))
        state = nxt
    return {n: min(c, (1 << KEY_BITS) - 1) for n, c in cuts.items()}


@dataclass(frozen=True)
class Tree:
    """Splits per level, as (node, dimension, cut, step): a row of the node at or above the
    cut moves ``step`` shards on.  low and high scale the dimensions."""
    levels: list[list[tuple[int, int, int, int]]]
    low: list[float]
    high: list[float]


def _columns(docs: DataFrame, text: str, key: str) -> list[Column]:
    return [F.col(key).alias("id"), F.xxhash64(text).alias("tie"), text_bytes(F.col(text)).alias("size"),
            text_crc(F.col(text)).alias("crc"), F.monotonically_increasing_id().alias("mid"),
            *[c.alias(f"{'ds'[_is_text(docs, name, key)]}{i}") for i, (name, c) in enumerate(dimensions(docs, text, key).items())]]


def _is_text(docs: DataFrame, name: str, key: str) -> bool:
    return name in ("source", "lang") or name == "id" and not isinstance(docs.schema[key].dataType, T.NumericType)


def metadata(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """One staged row of numbers per row of ``docs``, and the ranks of the text dimensions."""
    raw = staged(docs.select(*_columns(docs, text, key)), "metadata")
    ranks = value_ranks(raw)
    return (staged(with_ranks(raw, ranks), "metadata") if ranks else raw), ranks


def _step(rows: DataFrame, split: list[tuple], n_dims: int) -> DataFrame:
    moved = _joined(rows, split, "node long, dim int, cut long, step int", "left")
    right = F.coalesce(F.when(_at(moved, n_dims) >= F.col("cut"), F.col("step")), F.lit(0))
    return moved.withColumn("node", F.col("node") + right).drop("dim", "cut", "step")


def _start(meta: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    return meta.withColumns(_positions(low, high)).drop(*[f"d{i}" for i in range(len(low))]).withColumn(
        "node", F.lit(0).cast("long"))


def fit_tree(meta: DataFrame, *, target_bytes: int | None = None, shards: int | None = None) -> Tree:
    """The tree over all rows of ``metadata``, for so many shards or for shards of so many bytes."""
    names = sorted((c for c in meta.columns if c[0] == "d" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    n_dims = len(names)
    whole = meta.agg(F.sum("size").alias("w"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    total = whole["w"] or 0
    k_all = shards or max(1, math.ceil(total / target_bytes))
    low, high = ([whole[f"{f}_{n}"] or 0.0 for n in names] for f in ("min", "max"))
    rows = _start(meta, low, high)
    nodes, levels = {0: k_all}, []  # first shard of a node -> its number of shards
    while total and (wide := {n: k for n, k in nodes.items() if k > 1}):
        ext = _joined(rows, [(n, k) for n, k in wide.items()], "node long, k int", "inner").groupBy("node").agg(
            F.sum("size").alias("w"), *[f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(n_dims) for f in (F.min, F.max)])
        state = []
        for r in ext.collect():  # one row per node
            span = [r[f"max{i}"] - r[f"min{i}"] for i in range(n_dims)]
            k, dim = wide[r["node"]], span.index(max(span))
            state.append((r["node"], dim, r[f"min{dim}"], max(span).bit_length(), r["w"] * (k // 2) / k))
        cuts = _cuts(rows, state, n_dims, TOLERANCE * total / k_all)
        split = [(n, dim, cuts[n], wide[n] // 2) for n, dim, *_ in state]
        if not split:  # the nodes left to divide have no rows
            break
        levels.append(split)
        rows = _step(rows, split, n_dims)
        nodes = {m: h for n, k in nodes.items() for m, h in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, 1),))}
        if len(levels) % 4 == 0:  # a deep tree does not route every row through all its levels again
            rows = staged(rows, "kd-level")
    return Tree(levels, low, high)


def route(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` (with the columns of ``metadata``) plus ``shard``, by one lookup per level."""
    out = _start(rows, tree.low, tree.high)
    for split in tree.levels:
        out = _step(out, split, len(tree.low))
    return out.withColumn("shard", F.col("node").cast("int")).drop("node", *[f"k{i}" for i in range(len(tree.low))])


def with_slots(assigned: DataFrame) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... inside each shard."""
    n = max(16, math.ceil(assigned.count() / BUCKET_ROWS))
    df = assigned.withColumn("_b", F.pmod(F.xxhash64("id", "mid"), F.lit(n)))
    sums = df.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_b").orderBy("id", "tie", "mid")
    df = df.join(sums, ["shard", "_b"])
    return df.withColumn("slot", (F.col("_o") + F.row_number().over(inside) - 1).cast("long")).drop("_b", "_o")


def shard_table(docs: DataFrame, *, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, tie, mid, size, crc, shard, slot) per row of ``docs``."""
    meta, _ = metadata(docs, text, key)
    return with_slots(staged(route(meta, fit_tree(meta, shards=shards)), "assigned"))


def shard_documents(docs: DataFrame, *, target_bytes: int | None = None, shards: int | None = None,
                    text: str = "text", key: str = "doc_id", name: str = "shard") -> DataFrame:
    """All rows and columns of ``docs`` plus the shard, in column ``name`` (followed by ``_`` where
    ``docs`` has such a column).  The documents are routed where they are read; Spark broadcasts the
    ranks of source and language if they are few, and only joins a larger table by shuffle."""
    (name,) = fresh(docs, name)
    meta, ranks = metadata(docs, text, key)
    tree = fit_tree(meta, target_bytes=target_bytes, shards=shards)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_columns(docs, text, key))
    return route(with_ranks(rows, ranks), tree).select("row.*", F.col("shard").alias(name))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard below ``path``."""
    sharded.write.partitionBy("shard").parquet(path)
