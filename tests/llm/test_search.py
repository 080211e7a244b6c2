"""Ranked lexical search against brute force over edge tables."""

import math
import re
from collections import Counter

from rowaudit.llm import search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    by_item, out = {}, []
    for i, t in items:
        by_item.setdefault(i, set()).update(_terms(t))
    for i, ts in by_item.items():
        found = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


LONG = " ".join(f"w{i % 977} Ünï{i % 13}" for i in range(40_000))
DOCS = [(1, "Red fox, red DOG"), (2, "red fox, red dog"), (2, "red fox, red dog"), (None, "red fox, red dog"), (3, None), (4, ""), (5, " .,;\t"),
        (6, LONG), (7, "été_ÉTÉ fox-9 x"), (8, "w5 ünï3"), (9, "dog"), (9, "cat dog"), (None, None), (10, "ÜNÏ3 日本 日本")]
ITEMS = [(1, "fox"), (1, "w5 w6"), (2, None), (2, "red red dog dog"), (None, "日本 ünï3 Ünï3"), (4, ""), (5, "nobody says this"), (6, LONG)]


def _run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank", "'x' as item", "3 as doc", "4 as n")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id", "6 as score")
    return sorted(((r.item, r.rank, r.doc, r.score) for r in search.search(d.repartition(5), i, **kw).collect()), key=str)


def test_search_is_brute_force(spark):
    for k in (1, 3, 10):
        assert _run(spark, DOCS, ITEMS, k=k) == sorted(brute(DOCS, ITEMS, k), key=str)


def test_search_in_blocks(spark):
    assert _run(spark, DOCS, ITEMS, block_terms=40_000) == sorted(brute(DOCS, ITEMS, 10), key=str)


def test_search_empty_tables(spark):
    assert _run(spark, [], ITEMS) == [] and _run(spark, DOCS, []) == [] and _run(spark, [(1, None)], ITEMS) == []


def test_heaps_keep_the_best():
    heaps = search.Heaps(1, 2)
    for score, doc in ((5, 3), (5, None), (7, 9), (5, 1), (1, 0), (7, 2)):
        heaps.offer(0, score, search.Rank(doc))
    assert sorted((s, d.id) for s, d in heaps.heaps[0]) == [(7, 2), (7, 9)]
