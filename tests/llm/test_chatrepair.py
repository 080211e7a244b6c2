"""Conversation repair against a plain recursion over all edits, and over edge tables."""

import hashlib
import random
import re
from functools import lru_cache

from rowaudit.llm import chatrepair, queries

DUE = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def brute(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, text) of one conversation's rows in order."""
    seen, faults = set(), []
    for role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "fine" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        """Least (cost, audit, lines) from row i on, after ``inserts`` empty messages in a row."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 4:
            c, a, t = best(i, DUE[state], inserts + 1)
            found.append((c + 2, "I" + a, (NAME[DUE[state]] + ":", *t)))
        if i < len(rows):
            (role, text), extra = rows[i], faults[i] == "truncated"
            c, a, t = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, t))
            if faults[i] in ("fine", "truncated"):
                c, a, t = best(i + 1, DUE[state], 0)
                found.append((c + 2 + extra, "R" + a, (f"{NAME[DUE[state]]}:{text}", *t)))
                if role[:1] and (role[:1] == DUE[state] or (role[:1], state) == ("s", "")):
                    c, a, t = best(i + 1, role[:1], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *t)))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (*(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


def _made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(("system", "user", "user", "assistant", "assistant", "tool", "")),
             rng.choice(("One.", "Two!", "cut", "", " \t", "Tres?", "long. and cut", f"Own {rng.random()}."))) for _ in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def _got(spark, df, piece_rows=chatrepair.PIECE_ROWS):
    fixed = chatrepair.repair(df, piece_rows=piece_rows)
    sha = {r.conv: r.sha256 for r in chatrepair.digests(fixed).collect()}
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha[r.conv]) for r in fixed.summary.collect()}


def _want(gaps, rows):
    *counts, text = brute(rows)
    return (gaps, *counts, hashlib.sha256(text.encode()).hexdigest())


def test_walk_is_brute_force():
    for seed in range(300):
        rows = _made(seed, seed % 11)
        seen, kinds, initials = set(), [], []
        for role, text in rows:
            end = text.strip(" \t\n")[-1:]
            fault = 0 if not end or (role, text) in seen else 1 if end in ".!?" else 2
            seen.add((role, text))
            kinds.append(4 * fault + ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3))
        (letters, _), = chatrepair.walk(bytes(kinds), chatrepair.FINAL, (0,), True)
        want = brute(rows)
        assert letters == want[5], rows
        assert chatrepair.through(chatrepair.matrix(bytes(kinds)), chatrepair.FINAL)[0] == want[4]


def test_repair_in_pieces_is_brute_force(spark):
    convs = {c: _made(1000 + c, (0, 1, 2, 5, 9, 17)[c % 6]) for c in range(40)} | {None: _made(7, 30), 99: _made(8, 60)}
    rows = [(c, t, *m) for c, ms in convs.items() for t, m in enumerate(ms)]
    df = _frame(spark, random.Random(1).sample(rows, len(rows))).selectExpr("*", "1 as conv", "2 as pid", "3 as state", "'x' as digest")
    want = {c: _want(0, ms) for c, ms in convs.items() if ms}
    for size in (3, chatrepair.PIECE_ROWS):
        assert _got(spark, df, size) == want


def test_repair_edges(spark):
    long = "word " * 300_000
    rows = [(1, 3, "user", "Hi."), (1, None, "system", "Be kind."), (1, 9, "assistant", "Yes."), (1, 9, "assistant", "Yes."),
            (2, None, None, None), (2, None, "user", None), (3, 5, "user", long), (3, 6, "assistant", "Ok."),
            (4, 1, "user", "b."), (4, 1, "assistant", "a."), (4, 1, "user", "a.")]
    got = _got(spark, _frame(spark, rows))
    assert got[1] == _want(5, [("system", "Be kind."), ("user", "Hi."), ("assistant", "Yes."), ("assistant", "Yes.")])
    assert got[2] == _want(0, [(" ", " "), ("user", " ")]) and got[2][5:7] == (6, "DD")
    assert got[3] == _want(0, [("user", long), ("assistant", "Ok.")])
    assert got[4] == _want(0, [("assistant", "a."), ("user", "a."), ("user", "b.")])  # one turn: by role, then text
    assert _got(spark, _frame(spark, [])) == {}


def test_repaired_messages(spark):
    fixed = chatrepair.repair(_frame(spark, [(1, 0, "assistant", "Yes."), (1, 1, "user", "So?"), (1, 2, "user", "So?")]), piece_rows=2)
    out = chatrepair.repaired_messages(fixed).orderBy("pid", "seq", "at").collect()
    assert [(r.role, r.text) for r in out] == [("user", ""), ("assistant", "Yes."), ("user", "So?"), ("assistant", "")]
    assert fixed.summary.first().audit == "IKKDI"


def test_query_on_damaged_edges(spark, tmp_path):
    """Dropped rows, nulls in every column and repeated rows through the query itself."""
    rows = [(c, t, r, x) for c in (None, 0, 1, 2, 3) for t in (None, 0, 1, 2, 3, 7) for r, x in (("user", f"Is {t}?"), (None, "a"), ("assistant", None))]
    rows += [(50, t, "user", "Gone.") for t in range(2000) if queries_hit(50, t) == 0][:2]
    _frame(spark, rows + rows[:5]).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.QUERIES["op12_chat_repair"](spark, str(tmp_path)).collect()}
    want = {}
    for c, t, r, x in rows + rows[:5]:
        want.setdefault(c, [])
        r, x, hit = " " if r is None else r, " " if x is None else x, queries_hit(c, t)
        if hit:
            x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
            want[c] += [(t is not None, t or 0, "user" if hit == 4 else r, x)] * (2 if hit == 3 else 1)
    assert set(got) == set(want) and not want[50]
    for c, ms in want.items():
        turns = {t for known, t, *_ in ms if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        g = got[c]
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit, g.repaired_sha256) == _want(gaps, [m[2:] for m in sorted(ms)])


def queries_hit(conv, turn):
    import zlib
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
