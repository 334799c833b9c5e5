import math
import random
import re
from collections import Counter

import pytest

from scriptorium.llm import tiered_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs: list[tuple[int | None, str | None]], items: list[tuple[int | None, str | None]], top: int = 10) -> set[tuple]:
    bags = [(i, Counter(map(lower, TERM.findall(t or "")))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    N, L = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(map(lower, TERM.findall(t or "")))
    out = set()
    for item, terms in asked.items():
        scores = []
        for row, ((doc, bag), n) in enumerate(zip(bags, sizes)):
            m = 100 - 90 + (90 * n * N) // L if L else 0
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out |= {(item, k, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scores)[:top], 1)}
    return out


def made(n: int, seed: int) -> tuple[list, list]:
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Éte", "été", "naïve", "x9", "𝒳"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(r.choices(words, weights, k=r.choice([1, 3, 20, 60])))) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(40)]  # copies, whose scores are equal
    docs += [(None, "w3 w4"), (5, "W3, w4!"), (5, "w3 w4"), (900, None), (901, ""), (902, "?? --"), (903, "w1 " * 20_000 + "w59")]
    items = [(k, " ".join(r.choices(words, weights, k=r.choice([1, 4, 25])))) for k in range(30)]
    items += [(100, None), (101, "nobody has this"), (102, ""), (3, "w50 w51"), (None, "w3 w4"), (103, docs[3][1]), (104, "w3-w3_W3")]
    return docs, items


@pytest.mark.parametrize("least, blocks", [(1, 1_000_000), (5, 40), (20, 1_000_000), (10_000, 1_000_000)])
def test_equals_brute_force_whatever_the_tiers(spark, monkeypatch, least, blocks):
    monkeypatch.setattr(S, "LEAST_TIER", least)
    monkeypatch.setattr(S, "MAX_ASKED", blocks)
    docs, items = made(150, least)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, row long").repartition(5)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, item string")
    got = S.rank_documents(d, q).collect()
    assert {tuple(r) for r in got} == brute(docs, items)
    assert len(got) == len(set((r.item_id, r.rank) for r in got))


def test_all_terms_indexed_and_joined_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_TERMS", 0)
    monkeypatch.setattr(S, "MAX_BROADCAST", 0)
    monkeypatch.setattr(S, "LEAST_TIER", 8)
    docs, items = made(60, 9)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in S.rank_documents(d, q, top=4).collect()} == brute(docs, items, top=4)


def test_some_items_stop_at_the_first_tier_and_some_fall_through(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAST_TIER", 12)
    tiers: list[tuple[int, int]] = []
    whole = S._exact
    monkeypatch.setattr(S, "_exact", lambda index, reach, weights, top: (tiers.append(len({w[0] for w in weights})), whole(index, reach, weights, top))[1])
    docs = [(k, "common " * (k % 5 + 1) + (f"rare{k % 40}" if k < 400 else "")) for k in range(800)]
    docs += [(1000 + k, "other " * (k % 5 + 1)) for k in range(400)]
    items = [(0, "rare3 rare7"), (1, "common"), (9, "common other")] + [(2 + k, f"common rare{k}") for k in range(5)]
    got = S.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(docs, items)
    assert 0 < sum(tiers) < len(items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.rank_documents(none, some).collect() == []
    assert S.rank_documents(some.toDF("doc_id", "text"), none.toDF("item_id", "text")).collect() == []
    assert S.rank_documents(spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string"), some).collect() == []
