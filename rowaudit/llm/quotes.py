r"""Quotation linking for chat data.  DataFrame functions only.

A line that starts with ``>`` marks is quoted; the number of marks is its level.  Quoted
lines of one level in a row are a passage.  Passages, and their single lines of at least
three words, are normalised (lower case, runs of other characters than letters and digits
are one space) and hashed.  What a message says itself is hashed in the same way, as a
whole, by paragraph and by line.  A passage is linked to the message that said it first:
in the same conversation before the quoting message, else in another conversation of the table.  A message
replies to the message linked by its passage of the lowest level (whole passages before
lines, the first passage of equals), else to the message before it.

A message is known by its conversation and its position there (by turn, null first, then
text hash and role), so links between messages of one turn, or without a turn, count like
any other.

Threads follow the parents.  A link to a later place of the table (another conversation of
greater id) is reported as the parent, but the thread goes on to the message before, so that
there are no circles.  Root and depth of every message come from pointer doubling: each round
replaces a message's ancestor by that one's ancestor, so a chain of n messages takes log2(n)
rounds, each a join of small rows and staged.  ``thread_position`` numbers the messages of a
thread by depth, then conversation and position, so every reply follows what it answers;
across conversations too.  ``own`` is the text without quotes and without the line that
announces them.

Nothing is collected per conversation or thread.  Positions are sums of counts: per
(conversation, turn) after map-side combine, in blocks of 1,024 turns, and inside one turn in
64 hash groups; so a conversation with a third of all rows is numbered by many tasks.  Threads
are numbered by a range partitioning of all messages with offsets per partition.  Passages
are joined to the first occurrence only, one row per hash, and where that is in the quoting
conversation itself, to the first one in any other conversation.

Defined cases: null and empty texts say and quote nothing; rows equal in conversation,
turn, role and text are one message (same position, all rows stay); a null turn comes
first; a null conversation is one of its own and the first; messages of the same turn are
ordered by the hash of their text, then by role; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowaudit.llm.common import fresh, staged

QUOTED = r"^[ \t]*>"
MARKS = r"^((?:[ \t]*>)+)"
ANNOUNCES = r"(?i)^\s*(?:on\b.*\bwrote|.*\bschrieb\b.*|.*\ba écrit|.*\bescribió)\s*:\s*$"
LINE_WORDS, TURN_BLOCK = 3, 1024
KEYS = ("conv", "turn", "role", "tie")


def normal(text: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def own_text(text: Column) -> Column:
    """The text without quoted lines and, where it has any, the lines that announce them."""
    kept = F.filter(_lines(text), lambda x: ~x.rlike(QUOTED) & ~x.rlike(ANNOUNCES))
    return F.when(F.coalesce(text, F.lit("")).rlike(f"(?m){QUOTED}"), F.btrim(F.array_join(kept, "\n"), F.lit(" \t\r\n"))).otherwise(
        F.coalesce(text, F.lit("")))


def _said(own: Column) -> Column:
    """Hashes of what a message says: whole, paragraphs, lines."""
    parts = F.concat(F.array(own), F.split(own, r"\n[ \t]*\n"), F.split(own, "\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normal), lambda x: x != ""), lambda x: F.md5(x)))


def messages(chats: DataFrame, text: str = "text", conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """(conv, turn, role, tie, text) with tie a hash of the text."""
    return chats.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.col(text).alias("text"))


def passages(msgs: DataFrame) -> DataFrame:
    """(conv, turn, role, tie, passage, level, rank, hash) of the quoting messages: rank 0 is
    the whole passage, rank 1 one of its lines."""
    some = msgs.where(F.col("text").rlike(f"(?m){QUOTED}")).dropDuplicates(list(KEYS))
    lines = some.select(*KEYS, F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    lines = lines.select(*KEYS, "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
                         F.regexp_replace("line", MARKS, "").alias("body"))
    order = Window.partitionBy(*KEYS).orderBy("at")  # the lines of one message
    lines = lines.withColumn("new", (F.col("level") != F.lag("level", 1, 0).over(order)).cast("int"))
    lines = lines.withColumn("passage", F.sum("new").over(order)).where("level > 0")
    whole = lines.groupBy(*KEYS, "passage", "level").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("b"))
    texts = F.transform("b", lambda x: x["body"])
    lone = F.transform(F.filter(F.transform(texts, normal), lambda x: F.size(F.split(x, " ")) >= LINE_WORDS),
                       lambda x: F.struct(F.lit(1).alias("rank"), F.md5(x).alias("hash")))
    both = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.md5(normal(F.array_join(texts, "\n"))).alias("hash"))), lone)
    blank = normal(F.array_join(texts, "\n")) == ""
    return whole.where(~blank).select(*KEYS, "passage", "level", F.explode(both).alias("h")).select(
        *KEYS, "passage", "level", "h.rank", "h.hash")


def link_passages(msgs: DataFrame, places: DataFrame) -> DataFrame:
    """One row per quoting message and passage: position and level, and the message that said it first
    (to_conv, to_pos) with the rank of the match; null where nobody did.  ``places`` are the
    ``positions`` of the messages."""
    at = places.select(*KEYS, "position")
    quoted = staged(_safe(passages(msgs), at, KEYS), "passages")
    wanted = quoted.select("hash").distinct()
    said = msgs.select(*KEYS, F.explode(_said(own_text(F.col("text")))).alias("hash")).join(wanted, "hash", "left_semi")
    here = staged(_safe(said, at, KEYS).groupBy("conv", "hash").agg(F.min("position").alias("here")), "said")
    ever = here.groupBy("hash").agg(F.min(F.struct("conv", F.col("here").alias("pos"))).alias("ever"))
    # the first in another conversation, for hashes whose first one quotes them
    again = quoted.select("hash", "conv").join(ever, "hash").where(F.col("ever.conv").eqNullSafe(F.col("conv"))).select("hash", "ever")
    rest = here.join(again.distinct(), "hash").where(~F.col("ever.conv").eqNullSafe(F.col("conv")))
    ever = ever.join(rest.groupBy("hash").agg(F.min(F.struct("conv", F.col("here").alias("pos"))).alias("next")), "hash", "left")
    here = here.withColumnRenamed("conv", "c2")
    got = quoted.join(here, (quoted["hash"] == here["hash"]) & quoted["conv"].eqNullSafe(here["c2"]), "left").drop(here["hash"]).drop("c2")
    got = got.join(ever, "hash", "left")
    same = F.when(F.col("here") < F.col("position"), F.struct(F.col("rank"), F.lit(0).alias("far"), F.col("conv"), F.col("here").alias("pos")))
    far = F.when(F.col("ever.conv").eqNullSafe(F.col("conv")), F.col("next")).otherwise(F.col("ever"))
    other = F.when(far.isNotNull(), F.struct(F.col("rank"), F.lit(1).alias("far"), far["conv"].alias("conv"), far["pos"].alias("pos")))
    best = got.groupBy("conv", "position", "passage", "level").agg(F.min(F.coalesce(same, other)).alias("to"))
    return best.select("conv", "position", "passage", "level", F.col("to.rank").alias("rank"), F.col("to.far").alias("far"),
                       F.col("to.conv").alias("to_conv"), F.col("to.pos").alias("to_pos"))


def _safe(a: DataFrame, b: DataFrame, keys, how: str = "left") -> DataFrame:
    """Null-safe join on ``keys``; those of ``b`` are dropped."""
    names = fresh(a, *[f"_{k}2" for k in keys])
    b = b.withColumnsRenamed(dict(zip(keys, names)))
    cond = None
    for k, n in zip(keys, names):
        c = F.col(k).eqNullSafe(F.col(n))
        cond = c if cond is None else cond & c
    return a.join(b, cond, how).drop(*names)


def positions(keys: DataFrame) -> DataFrame:
    """(conv, turn, role, tie, position, before) of the distinct messages: position counts from
    0 in the conversation; before is the turn of the message ahead of it, null for the first."""
    one = keys.select(*KEYS).distinct().withColumn("part", F.shiftrightunsigned("tie", 58)).withColumn(
        "block", F.floor(F.col("turn") / TURN_BLOCK))
    small = one.groupBy("conv", "block", "turn", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("conv", "turn").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 64 rows
    small = small.withColumn("in_turn", F.coalesce(F.sum("n").over(by_part), F.lit(0)))
    turns = small.groupBy("conv", "block", "turn").agg(F.sum("n").alias("n"))
    blocks = turns.groupBy("conv", "block").agg(F.sum("n").alias("bn"), F.max("turn").alias("last"))
    by_block = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first())
    up = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("bn").over(up), F.lit(0)).alias("ahead"),
                           F.lag("last").over(by_block).alias("last"))
    by_turn = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first())  # 1,024 rows
    turns = turns.withColumn("in_block", F.coalesce(F.sum("n").over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turns = turns.withColumn("prior", F.lag("turn").over(by_turn)).drop("n")
    turns = _safe(turns, blocks, ("conv", "block")).select(
        "conv", "turn", (F.col("ahead") + F.col("in_block")).alias("ahead"), F.coalesce("prior", "last").alias("prior"))
    small = _safe(small.select("conv", "turn", "part", "in_turn"), turns, ("conv", "turn"))
    out = _safe(one.drop("block"), small, ("conv", "turn", "part"))
    inside = Window.partitionBy("conv", "turn", "part").orderBy("tie", "role")
    rank = F.col("in_turn") + F.row_number().over(inside) - 1
    out = out.withColumn("rank", rank)
    return out.select(*KEYS, (F.col("ahead") + F.col("rank")).alias("position"),
                      F.when(F.col("rank") > 0, F.col("turn")).otherwise(F.col("prior")).alias("before"))


def threads(parents: DataFrame) -> DataFrame:
    """(node, root, depth) from (node, up): up is null for a root, else a node that comes before in
    the order of nodes, so there are no circles."""
    root = F.col("up").isNull()
    state = staged(parents.select("node", F.coalesce("up", "node").alias("root"), F.when(root, 0).otherwise(1).cast("long").alias("depth")), "threads")
    total = None
    while (now := state.agg(F.sum("depth")).first()[0]) != total:
        total = now
        above = state.select(F.col("node").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        state = staged(state.join(above, "root").select("node", F.col("higher").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "threads")
    return state


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds ``name``, the place of each row from 0 in the order of the columns: range partitions are
    sorted and get offsets, one per partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pid, at, count, ahead = fresh(df, "_pid", "_at", "_count", "_ahead")
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn(pid, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = dealt.groupBy(pid).agg(F.count(F.lit(1)).alias(count)).withColumn(ahead, F.coalesce(F.sum(count).over(before), F.lit(0))).drop(count)
    local = F.col(at) - F.shiftleft(F.col(pid).cast("long"), 33)
    return dealt.join(F.broadcast(offsets), pid).withColumn(name, F.col(ahead) + local).drop(pid, at, ahead)


def reply_order(msgs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``messages``: keys, the columns in ``carry``, position, n_quotes,
    n_linked, parent_conv, parent_position, parent_turn (null for the first message), and the
    thread: root_conv, root_position, depth, thread_position."""
    places = staged(positions(msgs.select(*KEYS)), "positions")
    pick = F.min(F.when(F.col("rank").isNotNull(), F.struct("level", "rank", "far", "passage", "to_conv", "to_pos"))).alias("to")
    told = link_passages(msgs, places).groupBy("conv", "position").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("rank").alias("n_linked"), pick)
    linked, previous = F.col("to").isNotNull(), F.when(F.col("position") > 0, F.struct("conv", (F.col("position") - 1).alias("position")))
    to = F.struct(F.col("to.to_conv").alias("conv"), F.col("to.to_pos").alias("position"))
    node = F.struct("conv", "position")
    one = staged(_safe(places, told, ("conv", "position")).withColumns({"node": node, "parent": F.when(linked, to).otherwise(previous)}).withColumn(
        "up", F.when(linked & (to < node), to).otherwise(previous)), "parents")
    turns = one.select(F.col("node").alias("parent"), F.col("turn").alias("parent_turn"))
    tree = threads(one.select("node", "up")).withColumns({"_rc": F.col("root.conv"), "_rp": F.col("root.position"), "_c": F.col("node.conv"), "_p": F.col("node.position")})
    tree = numbered(tree, "_g", "_rc", "_rp", "depth", "_c", "_p")
    tree = tree.join(tree.groupBy("root").agg(F.min("_g").alias("_first")), "root")
    tree = tree.select("node", "root", "depth", (F.col("_g") - F.col("_first")).alias("thread_position"))
    found = one.join(turns, "parent", "left").join(tree, "node")
    out = _safe(msgs.select(*KEYS, *carry), found.select(*KEYS, "position", "n_quotes", "n_linked", "parent", "parent_turn", "root", "depth", "thread_position"), KEYS)
    return out.select(*KEYS, *carry, "position", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                      F.col("parent.conv").alias("parent_conv"), F.col("parent.position").alias("parent_position"), "parent_turn",
                      F.col("root.conv").alias("root_conv"), F.col("root.position").alias("root_position"), "depth", "thread_position")


def format_chats(chats: DataFrame, text: str = "text", conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The conversations without quotes: the columns of ``reply_order`` with ``own`` and
    ``chat`` (role header and own text), one row per message."""
    msgs = messages(chats, text, conv, turn, role)
    out = reply_order(msgs.withColumn("own", own_text(F.col("text"))), ("own",))
    header = F.concat(F.lit("<|"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.lit("|>\n"))
    return out.withColumn("chat", F.concat(header, F.col("own")))
