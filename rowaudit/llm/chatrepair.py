r"""Conversation structure repair by square-root checkpointed dynamic programming.

A well-formed conversation has the roles ``(system? (user assistant)+)?``.  Every message is kept
(cost 0), given the role that is due (Rerole, 2) or deleted (3; blank and repeated messages must
be), an empty message of the due role may be inserted anywhere (2), and a truncated message that
is not deleted adds 1.  The cheapest edits make the conversation well-formed; of equally cheap
ones the audit string of initials (D, I, K, R) that comes first in ASCII order counts.

The backward step is linear over (min, +) on a vector with one cost per state, so a conversation
of any length is worked in pieces:

1. ``pieces``: messages are sorted by conversation, turn, role and text with a range partitioning,
   so a conversation with a third of all rows lies in many partitions, and each run of at most
   ``PIECE_ROWS`` messages (or about ``PIECE_BYTES`` of text) becomes one staged row.
2. A message whose role and text were seen earlier is found by the first place of each (conversation,
   digest), taken with map-side combine.
3. Each piece is summed up as a 4 x 4 matrix of costs.  Streamed backwards per conversation, one row
   per piece and nothing held, the matrices give the cost vector at the end of every piece: the
   checkpoints.
4. ``walk`` goes forward through a piece: it keeps backward vectors only at every square root of
   the piece's length, recomputes one such block at a time and follows the least tight edit.  A piece
   that is not the first of its conversation is walked from each of the four states.
5. Streamed forwards per conversation, the end state of one piece picks the walk of the next.

Only the digest of a whole conversation (``digests``) reads its text in order; it streams pieces
and holds one.  That, like the audit string itself, is one value per conversation by its nature.

Defined cases: a null role or text is one space; null turns come first; messages of one turn are
ordered by role, then text (equal ones are adjacent); a null conversation id is a conversation; a
role is known by its first letter, and an empty or other one can only be given a new role or be
deleted; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowaudit.llm.common import BLANK, BLANK_CHARS, staged

PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
REROLE, DELETE, INSERT = 2, 3, 2
#: States: nothing yet, after system, after user, after assistant.  DUE is the state after the role
#: that is due, NAMES that role by state, STEP the state after a kept message of initial s, u, a, other.
DUE, NAMES = (2, 2, 3, 2), ("user", "user", "assistant", "user")
STEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
LEGAL = {(0, 1), (1, 2), (2, 1)}
FINAL = (0, 4, 2, 0)  # cost of ending in each state: inserts until the last is an assistant
FAR = 1 << 40
MUST, FINE, CUT = 0, 1, 2  # a message's kind is 4 * this + its initial


def _least(v: tuple) -> tuple[int, tuple]:
    """The least entry, and the vector less it."""
    low = min(v)
    return low, tuple(FAR if x > FAR // 2 else x - low for x in v)


@lru_cache(maxsize=1 << 16)
def back(kind: int, after: tuple) -> tuple[int, tuple]:
    """The cost vector before a message from the one after it, as (least, rest)."""
    fault, initial = divmod(kind, 4)
    out = []
    for q in range(4):
        best = after[q] + DELETE
        if fault != MUST:
            extra = fault == CUT
            best = min(best, after[DUE[q]] + REROLE + extra)
            if STEP[q][initial] is not None:
                best = min(best, after[STEP[q][initial]] + extra)
        out.append(best)
    for _ in range(2):  # inserts before the message
        out = [min(out[q], out[DUE[q]] + INSERT) for q in range(4)]
    return _least(tuple(out))


@lru_cache(maxsize=1 << 16)
def forth(kind: int, after: tuple, state: int) -> tuple[str, int]:
    """The letters of the least tight edits up to and with this message, and the state after it."""
    low, before = back(kind, after)
    fault, initial = divmod(kind, 4)
    letters = ""
    while True:
        need = before[state] + low
        if after[state] + DELETE == need:
            return letters + "D", state
        if before[DUE[state]] + low + INSERT == need:
            letters, state = letters + "I", DUE[state]
            continue
        extra, kept = fault == CUT, STEP[state][initial]
        if kept is not None and after[kept] + extra == need:
            return letters + "K", kept
        return letters + "R", DUE[state]


def matrix(kinds: bytes) -> list[int]:
    """Entry 4q + p: the least cost from state q before the messages to state p after them."""
    columns = []
    for p in range(4):
        total, v = 0, tuple(0 if q == p else FAR for q in range(4))
        for k in reversed(kinds):
            low, v = back(k, v)
            total += low
        columns.append([x + total if x < FAR // 2 else FAR for x in v])
    return [columns[p][q] for q in range(4) for p in range(4)]


def through(m: list[int], v: tuple) -> tuple:
    """The cost vector before a piece from the one after it."""
    return tuple(min(m[4 * q + p] + v[p] for p in range(4)) for q in range(4))


def walk(kinds: bytes, end: tuple, states: tuple[int, ...], last: bool) -> list[tuple[str, int]]:
    """(audit letters, end state) of the messages for each start state."""
    n = len(kinds)
    step = max(1, math.isqrt(n))
    _, v = _least(end)
    marks = [v]  # vectors at the ends of the blocks, last block first
    for i in range(n - 1, -1, -1):
        _, v = back(kinds[i], v)
        if i % step == 0 and i:
            marks.append(v)
    out, at = [[] for _ in states], list(states)
    for start in range(0, n, step):
        v = marks.pop()
        block = kinds[start:start + step]
        after = []
        for k in reversed(block):
            after.append(v)
            _, v = back(k, v)
        for k in block:
            v = after.pop()
            for j, q in enumerate(at):
                letters, at[j] = forth(k, v, q)
                out[j].append(letters)
    if last:
        for j, q in enumerate(at):
            out[j].append("I" * (FINAL[q] // INSERT))
            at[j] = q if not FINAL[q] else 3
    return [("".join(x), q) for x, q in zip(out, at)]


def render(letters: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The repaired messages of a piece."""
    out, at = ([], []), 0
    for x in letters:
        if x != "D":
            new = x != "K"
            role = NAMES[state] if new else roles[at]
            out[0].append(role)
            out[1].append("" if x == "I" else texts[at])
            state = DUE[state] if new else STEP[state]["sua".find(role[0])]
        at += x != "I"
    return out


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _map(df: DataFrame, schema: str, fn: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """``fn`` over the rows of each partition, in their order, as dictionaries; it yields tuples."""
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)

        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        held, size = [], 0
        for r in fn(rows()):
            held.append(r)
            size += 1 + sum(len(x) for x in r if isinstance(x, (str, bytes)))
            if len(held) >= 1024 or size > PIECE_BYTES:
                yield _rows({f.name: (list(v), f.type) for f, v in zip(kinds, zip(*held))})
                held, size = [], 0
        if held:
            yield _rows({f.name: (list(v), f.type) for f, v in zip(kinds, zip(*held))})

    return df.mapInArrow(run, out)


def _struct(df: DataFrame, ddl: str):
    """The type of column ``conv`` of ``df`` with the columns of ``ddl``."""
    from pyspark.sql.types import StructType

    return StructType([df.schema["conv"], *StructType.fromDDL(ddl)])


def _ordered(df: DataFrame, *order: Column) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def messages(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, base, initial): base is MUST for a blank text, CUT for a truncated one."""
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))
    who = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" "))
    end = F.right(F.btrim(said, F.lit(BLANK_CHARS)), F.lit(1))
    base = F.when(~said.rlike(f"[^{BLANK}]"), MUST).when(end.isin(".", "!", "?"), FINE).otherwise(CUT)
    first = F.left(who, F.lit(1))
    return chats.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), who.alias("role"), said.alias("text"),
                        base.alias("base"), F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"))


def pieces(msgs: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(conv, pid, seq, roles, texts, digests, base, initial): messages in order; pieces of a
    conversation are ordered by (pid, seq).  Staged."""
    n = int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.md5(F.concat_ws("\0", "role", "text"))
    keyed = msgs.withColumns({"digest": key, "_n": F.monotonically_increasing_id()})  # _n deals out equal messages
    dealt = keyed.repartitionByRange(n, "conv", "turn", "role", "text", "_n").sortWithinPartitions("conv", "turn", "role", "text")
    names = ("role", "text", "digest", "base", "initial")

    def cut(rows: Iterator[dict]) -> Iterator[tuple]:
        pid, seq, held, size, conv = TaskContext.get().partitionId(), 0, [], 0, None
        for r in rows:
            if held and (r["conv"] != conv or len(held) >= piece_rows or size >= PIECE_BYTES):
                yield conv, pid, seq, *([h[k] for h in held] for k in names)
                held, size, seq = [], 0, seq + 1
            conv = r["conv"]
            held.append(r)
            size += len(r["text"])
        if held:
            yield conv, pid, seq, *([h[k] for h in held] for k in names)

    schema = _struct(msgs, "pid int, seq long, roles array<string>, texts array<string>, digests array<string>, base array<int>, initial array<int>")
    return staged(_map(dealt, schema, cut), "pieces")


def _kinds(parts: DataFrame) -> DataFrame:
    """(conv, pid, seq, kinds, matrix, blank, duplicate, truncated, illegal) per piece; staged."""
    said = parts.select("conv", "pid", "seq", F.posexplode(F.arrays_zip("digests", "base")).alias("at", "x")).where(F.col("x.base") != MUST)
    first = said.groupBy("conv", "x.digests").agg(F.min(F.struct("pid", "seq", "at")).alias("f"))
    first = first.groupBy("f.pid", "f.seq").agg(F.collect_list("f.at").alias("new"))  # at most one piece's rows
    slim = parts.select("conv", "pid", "seq", "base", "initial").join(first, ["pid", "seq"], "left")

    def judge(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            new, base, initial = set(r["new"] or ()), r["base"], r["initial"]
            again = [b != MUST and i not in new for i, b in enumerate(base)]
            fault = [MUST if d else b for b, d in zip(base, again)]
            kinds = bytes(4 * f + i for f, i in zip(fault, initial))
            yield (r["conv"], r["pid"], r["seq"], kinds, matrix(kinds), base.count(MUST), sum(again), fault.count(CUT),
                   sum((a, b) not in LEGAL for a, b in zip(initial, initial[1:])))

    return staged(_map(slim, _struct(parts, "pid int, seq long, kinds binary, matrix array<long>, blank long, duplicate long, truncated long, illegal long"),
                       judge), "kinds")


def _ends(kinds: DataFrame) -> DataFrame:
    """Adds, per piece: end (cost vector after it), cost (of the conversation from it on), first and
    last in its conversation, and the illegal step to the next piece."""
    def chain(rows: Iterator[dict]) -> Iterator[tuple]:
        prior = None  # the row before, in descending order: its conversation may go on
        v = FINAL
        for r in rows:
            same = prior is not None and prior[0] == r["conv"]
            if prior is not None:
                yield (*prior, not same)
            v, ahead = (v, head) if same else (FINAL, None)
            end, k = v, r["kinds"]
            v = through(r["matrix"], v)
            step = ahead is not None and (k[-1] % 4, ahead) not in LEGAL
            prior = (r["conv"], r["pid"], r["seq"], k, list(end), v[0], r["blank"], r["duplicate"], r["truncated"], r["illegal"] + step, not same)
            head = k[0] % 4
        if prior is not None:
            yield (*prior, True)

    down = _ordered(kinds, F.col("pid").desc(), F.col("seq").desc())
    return staged(_map(down, _struct(kinds, "pid int, seq long, kinds binary, end array<long>, cost long, blank long, duplicate long, truncated long, "
                                            "illegal long, last boolean, first boolean"), chain), "ends")


def _letters(ends: DataFrame) -> DataFrame:
    """(conv, pid, seq, letters, state, alone): the audit of each piece and the state it starts in."""
    def walks(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            got = walk(r["kinds"], tuple(r["end"]), (0,) if r["first"] else (0, 1, 2, 3), r["last"])
            yield r["conv"], r["pid"], r["seq"], [x for x, _ in got], [q for _, q in got], r["first"] and r["last"]

    def pick(rows: Iterator[dict]) -> Iterator[tuple]:
        state, conv, begun = 0, None, False
        for r in rows:
            if not begun or r["conv"] != conv:
                state, conv, begun = 0, r["conv"], True
            yield conv, r["pid"], r["seq"], r["walks"][state], state, r["alone"]
            state = r["states"][state]

    done = _map(ends.repartition("pid", "seq"), _struct(ends, "pid int, seq long, walks array<string>, states array<int>, alone boolean"), walks)
    return staged(_map(_ordered(done, F.col("pid"), F.col("seq")), _struct(ends, "pid int, seq long, letters string, state int, alone boolean"), pick), "letters")


@dataclass(frozen=True)
class Repairs:
    """summary: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation;
    pieces: (conv, pid, seq, alone, roles, texts), the repaired messages in the order of (pid, seq)."""
    summary: DataFrame
    pieces: DataFrame


def repair(chats: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           piece_rows: int = PIECE_ROWS) -> Repairs:
    msgs = messages(chats, conv, turn, role, text)
    parts = pieces(msgs, piece_rows)
    ends = _ends(_kinds(parts))
    letters = _letters(ends)
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    costs = ends.groupBy("conv").agg(*counts, F.min_by("cost", F.struct("pid", "seq")).alias("cost"))
    span = F.max("turn") - F.min("turn") + 1
    gaps = msgs.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.coalesce(span - F.count("turn"), F.lit(0)).alias("gaps"))
    audit = letters.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pid", "seq", "letters"))).alias("x")).select(
        "conv", F.array_join("x.letters", "").alias("audit"))
    summary = costs.alias("c").join(gaps.alias("g"), F.col("c.conv").eqNullSafe(F.col("g.conv"))).join(
        audit.alias("a"), F.col("c.conv").eqNullSafe(F.col("a.conv"))).select(
        "c.conv", "g.gaps", "c.blank", "c.duplicate", "c.truncated", "c.illegal", "c.cost", "a.audit")

    def build(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            yield r["conv"], r["pid"], r["seq"], r["alone"], *render(r["letters"], r["state"], r["roles"], r["texts"])

    whole = parts.select("conv", "pid", "seq", "roles", "texts").join(letters.drop("conv"), ["pid", "seq"])
    return Repairs(summary, _map(whole, _struct(parts, "pid int, seq long, alone boolean, roles array<string>, texts array<string>"), build))


def repaired_messages(repairs: Repairs) -> DataFrame:
    """(conv, pid, seq, at, role, text): one row per message; ordered by (pid, seq, at)."""
    return repairs.pieces.select("conv", "pid", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "m")).select(
        "conv", "pid", "seq", "at", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


def digests(repairs: Repairs) -> DataFrame:
    """(conv, sha256) of the repaired ``role:text`` lines of each conversation, in lower-case hex."""
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    done = staged(repairs.pieces.select("conv", "pid", "seq", "alone", F.size("roles").alias("n"), F.when(F.col("alone"), F.sha2(lines, 256)).alias("sha256"),
                                        F.when(~F.col("alone"), lines).alias("body")), "bodies")

    def chain(rows: Iterator[dict]) -> Iterator[tuple]:
        h, conv, wrote = None, None, False
        for r in rows:
            if h is None or r["conv"] != conv:
                if h is not None:
                    yield conv, h.hexdigest()
                h, conv, wrote = hashlib.sha256(), r["conv"], False
            if r["n"]:
                h.update((("\n" if wrote else "") + r["body"]).encode())
                wrote = True
        if h is not None:
            yield conv, h.hexdigest()

    long = _map(_ordered(done.where(~F.col("alone")), F.col("pid"), F.col("seq")), _struct(done, "sha256 string"), chain)
    return done.where("alone").select("conv", "sha256").unionByName(long)
