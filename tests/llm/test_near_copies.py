import itertools
import random

import corpus_pipeline as pipeline
from scriptorium.llm.near_copies import shingle_hashes, without_near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_all_near_copies_from_08_on_go(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    texts = {i: [word() for _ in range(200)] for i in range(40)}
    for i in range(40):  # from one to six words changed: similarity from 0.95 to 0.77
        t = list(texts[i])
        for at in rnd.sample(range(10, 190), 1 + i % 6):
            t[at] = word()
        texts[100 + i] = t
    for i in range(60):  # one large group, and a line that all have
        t = list(texts[0])
        t[rnd.randrange(200)] = word()
        texts[200 + i] = t
    line = [word() for _ in range(12)]
    texts = {i: " ".join(t + line) for i, t in texts.items()}
    texts[500], texts[501], texts[502], texts[503] = "one two", "ONE  two", "", " \n"
    sets = {i: set(shingle_hashes(t).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = 0
    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            similar += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert similar > 1000 and 0 < sum(find(100 + i) == 100 + i for i in range(40)) < 20
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA).repartition(5)
    for chunk in (20_000, 4):  # lists in one part, and in parts of parts
        kept = [r.doc_id for r in without_near_copies(docs, chunk=chunk).collect()]
        assert sorted(kept) == sorted(i for i in texts if find(i) == i)


def test_near_copies_without_identifiers(spark, tmp_path):
    t = " ".join(f"w{i}" for i in range(100))
    rows = [(None, t, "a", "s", 0), (None, t + " x", "b", "s", 0), (None, "quite another text of its own here", "c", "s", 0), (5, t + " y", "d", "s", 0)]
    kept = pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(r.lang for r in kept) == ["c", "d"]
    assert pipeline.near(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0


def test_rows_of_one_hash_are_told_apart(spark, monkeypatch):
    from scriptorium.llm import near_copies as N

    real = N.row_key
    monkeypatch.setattr(N, "row_key", lambda *a: real(*a) % 3)
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 20 : k * 20 + 60])) for k in range(15)] + [(100 + k, " ".join([*words[k * 20 : k * 20 + 60], "more"])) for k in range(0, 15, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in without_near_copies(docs).collect()) == list(range(15))


def test_a_large_group_costs_few_pairs(spark, monkeypatch):
    import random

    from scriptorium.llm import near_copies as N

    r = random.Random(2)
    base = [f"b{i}" for i in range(150)]

    def variant(k):
        w = list(base)
        for _ in range(r.choice([1, 2, 4, 6])):
            w[r.randrange(150)] = f"x{k}_{r.random()}"
        return " ".join(w)

    n = 400
    texts = [variant(k) for k in range(n)]
    sets = [set(shingle_hashes(t).tolist()) for t in texts]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(n), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    tried = []
    verify = N.verified
    monkeypatch.setattr(N, "verified", lambda d, s, pairs, *a: (tried.append(pairs.count()), verify(d, s, pairs, *a))[1])
    kept = sorted(r.doc_id for r in without_near_copies(docs).collect())
    assert kept == [i for i in range(n) if find(i) == i] and 20 < len(kept) < n / 2
    assert sum(tried) < n * n / 8  # every pair would be n * n / 2


def test_the_stage_links_by_fingerprints_first(spark, tmp_path, monkeypatch):
    from scriptorium.llm import near_copies as N
    from scriptorium.llm.simhash import fingerprint

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    texts = {i: [word() for _ in range(1500)] for i in range(6)}
    for i in range(6):  # one word more: few bits change
        texts[100 + i] = [*texts[i], word()]
    for i in range(20):  # a fingerprint of a line that comes back, in texts of which most shingles differ
        texts[200 + i] = "a line that comes back".split() * 200 + [word() for _ in range(30)]
    texts = {i: " ".join(t) for i, t in texts.items()}
    texts[300], texts[301] = "", " \n"
    prints = {i: fingerprint(t, 5) for i, t in texts.items()}
    sets = {i: set(shingle_hashes(t).tolist()) for i, t in texts.items()}
    near = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if (prints[a] ^ prints[b]).bit_count() <= 4}
    similar = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near & similar) >= 5 and len(near - similar) >= 20
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA).repartition(3)
    both = sorted(r.doc_id for r in pipeline.near(spark, docs, str(tmp_path)).collect())
    nothing = lambda named, *a: named.select(named.key.alias("u"), named.key.alias("v")).limit(0)
    monkeypatch.setattr(N, "_stars", nothing)
    monkeypatch.setattr(N, "_apart", nothing)
    alone = sorted(r.doc_id for r in pipeline.near(spark, docs, str(tmp_path)).collect())
    assert alone == sorted(set(texts) - {b for _, b in near & similar})
    assert both == sorted(set(texts) - {b for _, b in similar})


def test_rows_linked_by_fingerprints_are_not_paired_again(spark, tmp_path, monkeypatch):
    from scriptorium.llm import near_copies as N

    rnd = random.Random(12)
    base = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = [" ".join([*base, f"end{i}"]) for i in range(30)]
    tried = []
    verify = N.verified
    monkeypatch.setattr(N, "verified", lambda d, s, pairs, *a: (tried.append(pairs.count()), verify(d, s, pairs, *a))[1])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert [r.doc_id for r in pipeline.near(spark, docs, str(tmp_path)).collect()] == [0]
    assert 29 <= tried[0] <= 58 and sum(tried[1:]) == 0


def test_rows_nearly_similar_to_a_large_group_make_few_pairs(spark, tmp_path, monkeypatch):
    from scriptorium.llm import near_copies as N

    rnd = random.Random(13)
    word = lambda: "".join(rnd.choices("abcdefghij", k=7))
    base = [word() for _ in range(400)]
    texts = []
    for k in range(240):  # from one word changed to 14: the last are similar to none, or to rows with like changes
        t = list(base)
        for at in rnd.sample(range(5, 395), 1 + k % 14):
            t[at] = word()
        texts.append(t)
    for k in range(0, 240, 20):  # a row that only such a row leads to
        t = list(texts[k + 13])
        for at in rnd.sample(range(5, 395), 2):
            t[at] = word()
        texts.append(t)
    texts = [" ".join(t) for t in texts]
    sets = [set(shingle_hashes(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    left = [i for i in range(len(texts)) if find(i) == i]
    assert 40 < len(left) < 160
    seen = spark.sparkContext.accumulator(0)
    pairs = N._pairs

    def counted(star, threshold):
        run = pairs(star, threshold)

        def seeing(batches):
            for b in run(batches):
                seen.add(0 if star else b.num_rows)
                yield b

        return seeing

    tried = []
    verify = N.verified
    monkeypatch.setattr(N, "_pairs", counted)
    monkeypatch.setattr(N, "verified", lambda d, s, p, *a: (tried.append(p.count()), verify(d, s, p, *a))[1])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in without_near_copies(docs).collect()) == left
    assert seen.value < 5 * len(texts) and tried[-1] < 6 * len(texts), (seen.value, tried)  # pairs of lists, and all of the last step
