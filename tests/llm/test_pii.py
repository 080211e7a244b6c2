"""Personal data: fixed patterns against plain regular expressions, the bootstrap against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from conftest import SF001
from rowaudit.llm import pii
from rowaudit.llm.common import table
from rowaudit.llm.queries import QUERIES

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(x):
    return re.sub("[^0-9]", "", x)


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    ok = (lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")),
          lambda x: 16 <= len(_digits(x)) <= 19 and _luhn(_digits(x)), lambda x: 8 <= len(_digits(x)) <= 15)
    return [(k, *m.span()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if ok[k](m[0])]


def test_base_spans_are_plain_regex(spark):
    rng = random.Random(3)
    parts = ["a", "Z9", "@", ".", "..", "_", "-", " ", "+", "+1", "(0", ")", "255", "256", "0001", "4111 1111 1111 1111", "4111111111111111", "é", "日",
             "a@b.c", "%", "1.2.3.4", "\n", "+49 30 1234567", "+1 (017) 555-7713"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(20_000)] + [r.text for r in table(spark, SF001, "documents").collect()]
    for t in texts:
        assert pii.scan((t or "").encode())[0] == plain_spans(t), t


def test_long_runs_take_linear_time():
    n = 300_000
    for text in ("a" * n, "1" * n, "a@" * n, "+" * n, "+1" + " " * n, "1." * n, "." * n, "a." * n + "@", "a@b." * n, "1 " * n, "x" * (6 << 20)):
        pii.scan(text.encode())


def test_pieces_give_the_same_tokens():
    rng = random.Random(1)
    text = " ".join(rng.choice(("word", "+1 (017) 555-7713", "x9x9x9", "a.b@c.de", "é.", "dots...")) for _ in range(3000)).encode()
    spans = pii.base_spans(text)
    for a, b in zip(pii.tokens(text, spans), pii.tokens(text, spans, piece=500)):
        assert np.array_equal(a, b)


def brute(texts, rounds=pii.ROUNDS):
    """Spans of each text by the same scores over words instead of hashes."""
    edges, filled, seeds = Counter(), Counter(), defaultdict(set)
    places = defaultdict(list)
    for n, text in enumerate(texts):
        data = (text or "").encode()
        base = [(k, len((text or "")[:a].encode()), len((text or "")[:b].encode())) for k, a, b in plain_spans(text)]
        start, end, _, span, like = pii.tokens(data, base)
        low = data.translate(pii._SEEN)
        words = [("kind", base[s][0]) if s >= 0 else low[a:b] for a, b, s in zip(start, end, span)]
        for j, s in enumerate(span):
            ctx = [(3, words[j - 1])] if j >= 1 else []
            ctx += [(1, words[j - 2], words[j - 1])] if j >= 2 else []
            ctx += [(2, words[j - 1], words[j + 1])] if 1 <= j < len(words) - 1 else []
            raw = data[start[j]:end[j]]
            kind = base[s][0] if s >= 0 else -1
            me = (kind, _digits(raw.decode()) if kind >= 2 else raw.lower())
            for p in ctx:
                if kind >= 0 or like[j]:
                    edges[p, me] += 1
                    if kind >= 0:
                        seeds[p].add(me)
                else:
                    filled[p] += 1
            if like[j]:
                places[me].append((n, len(data[:start[j]].decode()), len(data[:end[j]].decode())))
    edges = {e: n for e, n in edges.items() if len(seeds[e[0]]) >= pii.MIN_SEEDS}
    total = Counter()
    for (p, _), n in edges.items():
        total[p] += n
    known = {me: (me[0], pii.ONE) for (_, me) in edges if me[0] >= 0}
    accepted = {}
    for _ in range(rounds):
        mass = Counter()
        for (p, me), n in edges.items():
            if me in known or me in accepted:
                kind, score = known.get(me) or accepted[me]
                mass[p, kind] += n * score
        conf = {pk: m // (total[pk[0]] + filled[pk[0]] + 1) for pk, m in mass.items()}
        doubt = Counter()
        for (p, me), _ in edges.items():
            for kind in range(4):
                if me[0] < 0 and conf.get((p, kind), 0) >= pii.CONFIDENT * pii.ONE:
                    doubt[me, kind] += math.floor(math.log(1 - min(conf[p, kind], pii.ONE - 1) / pii.ONE) * -pii.ONE)
        best = {}
        for (me, kind), e in doubt.items():
            score = math.floor((1 - math.exp(-e / pii.ONE)) * pii.ONE)
            if score >= pii.ACCEPT * pii.ONE:
                best[me] = max(best.get(me, (-1, 0)), (score, -kind))
        if len(best) == len(accepted):
            break
        accepted = {me: (-k, s) for me, (s, k) in best.items()}
    out = [[(pii.KINDS[k], a, b) for k, a, b in plain_spans(t)] for t in texts]
    found = [[] for _ in texts]
    for me, (kind, _) in accepted.items():
        for n, a, b in places[me]:
            found[n].append((kind, a, b))
    return [pii.describe(o + [(f"found_{pii.KINDS[k]}", a, b) for k, a, b in sorted(f)]) for o, f in zip(out, found)]


def _contacts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    out = []
    for i in range(60):
        fill = [word() for _ in range(12)]
        out.append(" ".join([*fill[:4], "Please write to", f"{word()}@mail.example.com", "soon.", *fill[4:8], "Call mobile number:",
                             f"+49 30 {rng.randint(10**6, 10**7 - 1)}", *fill[8:], f"the year {rng.randint(10000, 99999)}"]))
    out += ["Please write to jo.doe(at)host77.example soon.", "é Call mobile number: 0151-2345678 now", "Nobody knows 0151-2345678 here.",
            "Call mobile number: 0171-9988776, please", "Build 20240115 of version 10.2-rc1 is out.", "the year 12345"]
    return out


def test_bootstrap_is_brute_force(spark):
    texts = _contacts() + [None, "", "x " * 200_000, _contacts()[0], _contacts()[0]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as mentions", "2 as n", "3 as kind")
    got = pii.find_pii(d.repartition(3)).collect()
    texts += [texts[3], texts[3]]
    want = brute(texts)
    key = lambda x: (x[0] is None, x)
    assert sorted((str(r.id), r.spans) for r in got) == sorted((str(i), s) for (i, _), s in zip(rows, want))
    at = texts.index("Nobody knows 0151-2345678 here.")
    assert want[at] == "found_phone:13:25"  # learned in its context, found elsewhere
    assert want[texts.index("Build 20240115 of version 10.2-rc1 is out.")] == "" and key
    assert sum(r.n_found for r in got) == sum(s.count("found_") for s in want) >= 3


def test_query(spark):
    docs = table(spark, SF001, "documents").orderBy("doc_id").collect()
    want = {r.doc_id: (plain_spans(r.text), s) for r, s in zip(docs, brute([r.text for r in docs]))}
    rows = QUERIES["op13_pii"](spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans, all_of_them = want[r.doc_id]
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == all_of_them


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(d).count() == 0
    (r,) = pii.find_pii(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert (r.id, r.n_email, r.n_found, r.base, r.spans) == (None, 0, 0, "", "")
