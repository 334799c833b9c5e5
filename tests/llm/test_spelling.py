import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from scriptorium.llm.spelling import Trie, near_words, pairs, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def distance_one(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(docs, drop=31, min_length=7, min_count=2) -> Counter:
    n = Counter()
    for i, text in docs:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return Counter({w: k for w, k in n.items() if k >= min_count and len(w) >= min_length})


def brute(n: Counter) -> set[tuple]:
    """Near words by patterns with one code point left out, which distance one implies."""
    by = defaultdict(set)
    for w in n:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for some in by.values():
        for a in some:
            near[a] |= {b for b in some if b not in near[a] and distance_one(a, b)}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def check(spark, docs, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long").repartition(4)
    got = variants(df, **options).collect()
    options.pop("group", None)
    assert {tuple(r) for r in got} == brute(vocabulary(docs, **options))
    assert len(got) == len({r.word for r in got})


def test_walk_finds_all_pairs():
    r = random.Random(1)
    words = sorted({"".join(r.choices("abé", k=r.randint(0, 6))) for _ in range(300)})
    got = [(words[x], words[y]) for x, y in Trie(words).near()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if distance_one(a, b)}


def test_pairs_of_a_trie_leave_others_to_theirs():
    words = ["abcdxyz", "abcdxyw", "abcexyz", "abcdxyzz", "abcdxzz", "abcdxyzzz"]
    assert {(words[x], words[y]) for x, y in pairs(words, 7, 3, 0, 0)} == {(a, b) for a in words for b in words if distance_one(a, b) and 7 in (len(a), len(b))}


@pytest.mark.parametrize("group", [5_000, 3, 1])
def test_equals_brute_force(spark, group):
    r = random.Random(group)
    base = ["".join(r.choices("abcd", k=r.choice([7, 8, 8, 9, 12]))) for _ in range(60)]
    odd = [w[:i] + c + w[i + 1 :] for w in base for i, c in [(r.randrange(len(w)), r.choice("abcdéà"))]] + [w[:3] + w[4:] for w in base] + [w[:5] + "z" + w[5:] for w in base]
    docs = [(k, " ".join(r.choices(base, [1 / (j + 1) for j in range(60)], k=80) + r.choices(odd, k=8))) for k in range(60)]
    docs += [(None, "Straßen straßen, STRASSEN strassen"), (3, None), (4, ""), (5, "10,000 ?"), (6, docs[6][1]), (6, docs[6][1])]
    check(spark, docs, group=group)


def test_long_words_and_hot_groups(spark):
    long = "ab" * 1_000
    docs = [(1, f"{long} {long} {long}c {long}c {long[:1_400]}x{long[1_401:]} x"), (2, f"{long[:1_400]}x{long[1_401:]} {long[:9]}")]
    docs += [(10 + k, " ".join(f"internation{chr(97 + k % 26)}{c}{d}" for c in "abc" for d in "abcdefgh")) for k in range(60)]
    docs += [(100 + k, "aaaaaaa aaaaaaaa aaaaaaaaa aaaaaaab baaaaaaa") for k in range(30)]
    check(spark, docs, drop=0, group=20)
    check(spark, docs)


def test_a_word_of_a_million_letters(spark):
    a = "ab" * 500_000
    b = a[:700_000] + "x" + a[700_001:]
    df = spark.createDataFrame([(a, 40), (b, 2), (a + "c", 3), ("wordaaa", 9)], "word string, n long")
    got = {r.word: (r.n_near, r.best) for r in near_words(df).collect()}
    assert got == {a: (2, a + "c"), b: (1, a), a + "c": (1, a)}


def test_chains_of_forms_lead_to_the_last(spark):
    docs = [(k, "wordaaaa " * 2000) for k in range(1)] + [(2, "wordaaab " * 200), (3, "wordaabb " * 20), (4, "wordabbb " * 2), (5, "wordaabb")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in variants(df, drop=0).collect()}
    assert got == {"wordaaaa": (None, "wordaaaa"), "wordaaab": ("wordaaaa", "wordaaaa"), "wordaabb": ("wordaaab" if 200 >= 10 * 21 else None, "wordaabb"), "wordabbb": ("wordaabb", "wordaabb")}
    docs[2] = (3, "wordaabb " * 18)
    got = {r.word: (r.form, r.root) for r in variants(spark.createDataFrame(docs, "doc_id long, text string"), drop=0, ratio=9).collect()}
    assert got["wordabbb"] == ("wordaabb", "wordaaaa")


def test_ties_take_the_smallest_word(spark):
    df = spark.createDataFrame([("wordaab", 20), ("wordaac", 20), ("wordaaa", 2), ("éordaaa", 30), ("wordaaaz", 1)], "word string, n long")
    got = {r.word: (r.n_near, r.best, r.best_n) for r in near_words(df).collect()}
    assert got["wordaaa"] == (4, "éordaaa", 30) and got["wordaab"] == (2, "wordaac", 20) and got["wordaaaz"] == (1, "wordaaa", 2)


def test_empty_tables(spark):
    assert variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert variants(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")).collect() == []


def test_query_on_the_given_documents(spark):
    from scriptorium.llm.queries import op11_spelling

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in op11_spelling(spark, "/root/testdata/sf0.001").collect()} == brute(vocabulary([tuple(r) for r in rows]))
