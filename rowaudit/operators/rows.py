"""Row identity and reproducible order: row ids, global ranks, folds,
bounded samples and seeded shuffles.

Nothing here uses a window without a partition (that would pull every row
into one task).  Global ranks are computed with hash-prefix buckets: count
rows per bucket (a small table), turn the counts into offsets, and number
rows only inside their bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowaudit.functions.hashing import seeded_key

# Rows per bucket we are happy to sort inside one task.
TARGET_BUCKET_ROWS = 1_000_000
# Range buckets of an integer key.
RANGE_BUCKETS = 4096
# Offset tables up to this many rows are broadcast; larger ones are joined.
BROADCAST_ROWS = 2_000_000


def with_row_id(df: DataFrame, key: str | None = None, name: str = "row_id",
                checkpoint: bool = True) -> DataFrame:
    """Attach a unique long ``row_id``.

    With ``key`` the caller's unique key is used (preferred: free and stable).
    Without one, rows are numbered 0..n-1 in file/partition order, like
    ``zipWithIndex``: one small job counts rows per partition, the counts
    become offsets, and each row adds its position inside the partition.
    The input is checkpointed first so both passes see the same partitions.
    """
    if key is not None:
        return df.withColumn(name, F.col(key).cast("long"))
    if checkpoint:
        from rowaudit.session import cut_lineage
        df = cut_lineage(df)
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per input partition: a bounded table, safe to order globally
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    out = tagged.join(F.broadcast(offsets), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return out.withColumn(name, (F.col("_off") + local).cast("long")).drop("_pid", "_mid", "_off")


def _group_sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """(rows in the largest group, number of groups) in one job."""
    if not by:
        return df.count(), 1
    r = df.groupBy(*by).count().agg(F.max("count"), F.count(F.lit(1))).first()
    return int(r[0] or 0), int(r[1] or 0)


def global_rank(df: DataFrame, key: str, by: list[str] | None = None,
                tie: str = "row_id", name: str = "rank", n: int | None = None, bucket=None) -> DataFrame:
    """1-based rank of each row by the hex string ``key`` (then ``tie``),
    numbered across the whole table or within each ``by`` group.

    Equals ``row_number() over (partition by <by> order by key, tie)`` but
    spreads the work over hash-prefix buckets, so one huge group (or the whole
    table) is never sorted by a single task.
    """
    by = list(by or [])
    n_max, n_groups = (n, 1) if (n is not None and not by) else _group_sizes(df, by)
    digits = max(2, math.ceil(math.log(max(n_max, 1) / TARGET_BUCKET_ROWS, 16)))
    staged = df.withColumn("_bucket", F.substring(F.col(key), 1, digits) if bucket is None else bucket)
    counts = staged.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # null group values are a group of their own: the join is null-safe
    here = {c: f"_o{i}" for i, c in enumerate([*by, "_bucket"])}
    offsets = offsets.withColumnsRenamed(here)
    # the offset table has at most groups * 16^digits rows: broadcast only under that proven bound
    offsets = F.broadcast(offsets) if n_groups * max(16 ** digits, RANGE_BUCKETS) <= BROADCAST_ROWS else offsets
    cond = None
    for c, o in here.items():
        same = F.col(c).eqNullSafe(F.col(o))
        cond = same if cond is None else cond & same
    joined = staged.join(offsets, cond).drop(*here.values())
    within = Window.partitionBy(*by, "_bucket").orderBy(F.col(key), F.col(tie))
    return joined.withColumn(name, (F.col("_off") + F.row_number().over(within)).cast("long")).drop("_bucket", "_off")


def stratified_folds(df: DataFrame, label: str, k: int, seed: int = 42,
                     shuffle: bool = True, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 per row with class proportions kept.

    shuffled: rows of each class are dealt round-robin in md5(seed:row_id)
    order.  unshuffled: each class is cut into k contiguous blocks in row order
    (first ``n % k`` blocks one row larger), as an unshuffled stratified split.
    """
    if shuffle:
        keyed = df.withColumn("_k", seeded_key(seed, "row_id"))
        ranked = global_rank(keyed, "_k", by=[label], name="_r")
        return ranked.withColumn(name, ((F.col("_r") - 1) % k).cast("int")).drop("_k", "_r")
    # Unshuffled: the labels, sorted, are dealt round-robin into k folds; each
    # class then fills its folds as contiguous blocks in row order.  Class c
    # occupies sorted positions [s, s+n); fold i gets the positions p with
    # p % k == i.  Block table: (#classes x k) rows, broadcast if few.
    lo, hi = df.agg(F.min("row_id"), F.max("row_id")).first()
    width = max(1, ((hi or 0) - (lo or 0)) // RANGE_BUCKETS + 1)
    spread = F.floor((F.col("row_id") - F.lit(lo or 0)) / F.lit(width)).cast("long")
    ranked = global_rank(df, "row_id", by=[label], name="_r", bucket=spread)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_cn"))
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_s", F.coalesce(F.sum("_cn").over(before), F.lit(0)))
    blocks = sizes.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    hi_p = F.col("_s") + F.col("_cn") - 1 - F.col(name)
    lo_p = F.col("_s") - 1 - F.col(name)
    blocks = blocks.withColumn("_alloc", F.floor(hi_p / k) - F.floor(lo_p / k))
    upto = Window.partitionBy(label).orderBy(name)
    blocks = blocks.withColumn("_hi", F.sum("_alloc").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_alloc"))
    blocks = blocks.select(label, name, "_lo", "_hi")
    cond = ranked[label].eqNullSafe(blocks[label]) & (ranked["_r"] > blocks["_lo"]) & (ranked["_r"] <= blocks["_hi"])
    few = sizes.count() * k <= BROADCAST_ROWS
    out = ranked.join(F.broadcast(blocks) if few else blocks, cond).drop(blocks[label])
    return out.withColumn(name, F.col(name).cast("int")).drop("_r", "_lo", "_hi")


def bounded_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows without replacement, reproducible under any partitioning.
    The bound is the feature here (a top-n by seeded hash)."""
    return df.withColumn("_k", seeded_key(seed, "row_id")).orderBy("_k", "row_id").limit(n).drop("_k")


def shuffle_with_mapping(df: DataFrame, seed: int = 42) -> DataFrame:
    """Seeded random order: ``new_id`` = position 0..n-1 in md5(seed:row_id)
    order; the old id stays in ``orig_id`` so truth sets can be carried over."""
    keyed = df.withColumn("_k", seeded_key(seed, "row_id"))
    ranked = global_rank(keyed, "_k", name="_r")
    return ranked.withColumn("orig_id", F.col("row_id")).withColumn(
        "new_id", F.col("_r") - 1).drop("_k", "_r")
