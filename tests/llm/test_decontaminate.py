import math
import random
import re

from scriptorium.llm.decontaminate import contained_items, decontaminate


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, threshold=0.8):
    out = set()
    for i, q in items:
        w = words(q)
        if not w:
            continue
        n = min(5, len(w))
        g = grams(w, n)
        for d, t in docs:
            k = len(g & grams(words(t), n))
            if k >= math.ceil(len(g) * threshold - 1e-9):
                out.add((d, i, len(g), k))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(40)] + ["É", "x1"]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ",", ".", "!!"]) for _ in range(n))
    items = [(i, text(rnd.choice([3, 5, 6, 12, 30]))) for i in range(25)] + [(90, None), (91, "..."), (92, "one"), (7, text(9))]
    docs = []
    for d in range(120):
        parts = [text(rnd.randint(0, 200))]
        for _ in range(rnd.randint(0, 2)):
            q = (rnd.choice(items)[1] or "").split()
            for k in range(0, len(q), 9):  # some items with words changed
                if rnd.random() < 0.15:
                    q[k] = "changed"
            parts += [" ".join(q).upper() if rnd.random() < 0.3 else " ".join(q), text(rnd.randint(0, 60))]
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "one"), (503, text(8000))]
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id long").repartition(5)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert want
    for limit in (200_000, 0):
        got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in contained_items(df, it, max_broadcast=limit).collect()}
        assert got == want
    bad = {d for d, *_ in want}
    kept = decontaminate(df, it)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - bad


def test_empty_tables_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "A b, c d e f")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in contained_items(df, it).collect()) == ["1", "1", "None"]
    assert contained_items(df.limit(0), it).collect() == [] and contained_items(df, it.limit(0)).collect() == []
    assert decontaminate(df, it.limit(0)).count() == 3


def test_rows_of_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from scriptorium.llm import decontaminate as D

    real = D.row_key
    monkeypatch.setattr(D, "row_key", lambda i, t: F.struct(F.lit(7).cast("long").alias("a"), real(i, t)["b"].alias("b")))
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (1, "quite another text that is clean"), (None, "also clean words stand in here")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "two three four five six")], "item_id long, text string")
    assert sorted(r.text[:5] for r in D.decontaminate(docs, items).collect()) == ["also ", "quite"]
