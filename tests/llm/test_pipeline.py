import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as pipeline
from scriptorium.llm import quality as quality_model
from scriptorium.llm.exact_dedup import without_copies
from scriptorium.llm.near_copies import shingle_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_small_corpus(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ther", "and", "ing", "ea", "tion", "or"]) for _ in range(rnd.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    texts = {i: prose(rnd.randint(40, 120)) for i in range(60)}
    texts |= {i: " ".join(f"{word()}$$$ {word()}###" for _ in range(60)) for i in range(60, 90)}
    item = prose(30)
    texts[100] = texts[7]
    texts[101] = prose(60) + " " + item + " " + prose(60)
    texts[102] = None
    labels = [(i, int(i < 60), 0) for i in range(90)]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.collect()}
    assert not kept["quality"] & set(range(60, 90))
    assert len(kept["quality"] & set(range(60))) >= 58
    assert 100 in kept["exact_dedup"] and 7 not in kept["exact_dedup"]
    assert 101 in kept["near_dedup"] and 101 not in kept["decontaminate"]
    assert {r.doc_id for r in pipeline.run(spark, d).select("doc_id").collect()} == kept["decontaminate"]


def test_rows_without_identifiers_are_told_by_their_texts(spark, tmp_path):
    rnd = random.Random(4)
    prose = lambda: " ".join("".join(rnd.choices(["ther", "and", "ing", "ea"], k=2)) for _ in range(60)) + "."
    junk = lambda: " ".join("x$$$ y###" for _ in range(rnd.randint(50, 70)))
    good, bad = [prose() for _ in range(60)], [junk() for _ in range(30)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good + bad)]
    rows += [(None, prose(), "en", "new", 0) for _ in range(5)] + [(None, junk(), "en", "junk", 0) for _ in range(5)]
    rows += [(900, prose(), "en", "new", 0), (900, prose(), "en", "new", 0), (900, junk(), "en", "junk", 0)]
    rows += [(None, good[0], "en", "copy", 0), (900, good[1], "en", "copy", 0), (900, good[1], "en", "copy", 0)]
    d = str(tmp_path)
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    accepted = pipeline.quality(spark, docs, d).cache()
    of = lambda df, source: [r.text for r in df.where(f"source = '{source}'").collect()]
    assert len(of(accepted, "new")) == 7 and not of(accepted, "junk")
    left = pipeline.exact(spark, accepted, d).cache()
    assert len(of(left, "new")) == 7 and of(left, "copy") == [good[1]]
    assert len(of(pipeline.near(spark, left, d), "new")) == 7


CLASH = ", __key string, __bad string, __id string, __sha string, bad_key string, key_of_row string, sha_of_text string, id_that_stays string, score string, `key` string, h string, root string"


def corpus(rnd):
    """Rows with null and repeated identifiers, copies, near copies, items of a test and empty texts, and a test."""
    word = lambda: "".join(rnd.choice(["ther", "and", "ing", "ea", "tion", "or"]) for _ in range(rnd.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(1, prose(20)), (2, None), (3, prose(6)), (3, "one two")]
    base = [prose(rnd.randint(40, 90)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(None, None), (70, ""), (70, None), (71, "ONE two"), (None, prose(50))]
    for k in range(40):
        t = base[k % 30]
        kind = k % 5
        if kind == 1:
            w = t.split()
            w[rnd.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 2:
            t = f"{prose(30)} {items[0][1] if k % 2 else items[2][1]} {prose(30)}"
        rows.append((rnd.choice([None, 7, 500 + k]), t))
    rows += rows[:3] + [(900, base[0])] * 3
    return rows, items


def brute(rows, items):
    """What the stages from exact copies to test items keep, as sorted pairs of identifier and text."""
    out = []
    rows = [(i, t or "") for i, t in rows]
    for t in {t for _, t in rows}:  # of equal texts the largest identifier
        out.append((max((i for i, x in rows if x == t and i is not None), default=None), t))
    yield sorted(out, key=str)
    sets = [set(shingle_hashes(t).tolist()) for _, t in out]
    root = list(range(len(out)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(out)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(out)):
        groups.setdefault(find(i), []).append(out[i])
    yield list(groups.values())
    words = lambda t: re.findall(r"[^\W_]+", t.lower())

    def has(t):
        for _, q in items:
            w = words(q or "")
            n = min(5, len(w))
            g = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            x = words(t)
            if g and len(g & {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}) >= 0.8 * len(g) - 1e-9:
                return True
        return False

    yield has


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_against_brute_force(spark, tmp_path, seed):
    rows, items = corpus(random.Random(seed))
    d = str(tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *"abcdefghijkl") for i, t in rows], SCHEMA + CLASH).repartition(5)
    told = lambda df: sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    alone, groups, has = brute(rows, items)
    kept = pipeline.exact(spark, docs, d)
    assert kept.columns == docs.columns and told(kept) == alone
    assert told(without_copies(docs, max_broadcast=0)) == alone
    near = pipeline.near(spark, kept, d)
    left = told(near)
    assert near.columns == docs.columns and len(left) == len(groups)
    for g in groups:  # of a group with identifiers the smallest stays
        ids = [i for i, _ in g if i is not None]
        mine = [x for x in left if x in g]
        assert len(mine) == 1 and (not ids or mine[0][0] == min(ids))
    clean = pipeline.clean(spark, near, d)
    assert clean.columns == docs.columns and told(clean) == [x for x in left if not has(x[1])] and len(told(clean)) < len(left)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    coded = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in pipeline.encode(spark, clean, d).collect()), key=str)
    ids = [(i, np.array(lib.encode_ordinary(t), "<u4")) for i, t in told(clean)]
    assert coded == sorted(((i, len(x), hashlib.sha256(x.tobytes()).hexdigest()) for i, x in ids), key=str)


def test_first_stage_keeps_what_the_classifier_accepts(spark, tmp_path):
    rnd = random.Random(5)
    rows, _ = corpus(rnd)
    rows += [(1000 + i, " ".join("x$$$ y###" for _ in range(rnd.randint(20, 60)))) for i in range(30)] + [(None, "x$$$ y### " * 30)]
    d = str(tmp_path)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(1000 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *"abcdefghijkl") for i, t in rows], SCHEMA + CLASH).repartition(3)
    kept = pipeline.quality(spark, docs, d)
    assert kept.columns == docs.columns
    model = quality_model.fit(docs, labels)
    want = [(i, t or "") for i, t in rows if model.score(quality_model.features(t or "")[None])[0] >= 0.5]
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    assert pipeline.run(spark, d).collect() == []
    rows = spark.createDataFrame([(1, "a b c", "en", "s", 0), (None, None, "en", "s", 0)], SCHEMA)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, rows, d).count() == 2
