import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa

from scriptorium.llm import quality, toxicity

WORDS = ["ther", "and", "ing", "eat", "tion", "or", "lan", "so"]


def prose(rnd, n, extra=()):
    w = ["".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 3))) for _ in range(n)]
    for x in extra:
        w.insert(rnd.randint(0, len(w)), x)
    return " ".join(w)


def auc(s, y):
    s, y = np.array(s), np.array(y)
    return float((s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean())


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(4)
    rows, labels = [(None, "no id", "en"), (90_001, None, "en"), (90_002, "x " * 50_000, "en")], []
    for i in range(500):
        good = rnd.random() < 0.8
        t = prose(rnd, rnd.randint(20, 100))
        rows.append((i, t if good else t.upper() if i % 2 else " ".join(f"{w}$$$" for w in t.split()), "en"))
        if i % 3:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    test = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out for i, _ in test)
    assert auc([by[i].score for i, _ in test], [y for _, y in test]) > 0.97


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), none).collect() == []


def halves(seed, n=2000, share=0.5, k=5):
    rnd = np.random.default_rng(seed)
    pos, neg = rnd.normal(1.5, 1, (n, k)), rnd.normal(-1.5, 1, (n, k))
    unl = np.concatenate([rnd.normal(1.5, 1, (int(n * share), k)), rnd.normal(-1.5, 1, (n - int(n * share), k))])
    return pos, neg, rnd.permutation(unl)


def test_the_fit_tells_negatives_and_the_prior_is_near():
    for share in (0.2, 0.5, 0.85):
        pos, neg, unl = halves(1, share=share)
        prior = quality.class_prior(pos, unl)
        assert abs(prior - share) < 0.07, (share, prior)
        m = quality.fit_nnpu(pos, unl, prior)
        assert (m.score(neg) < 0.5).mean() > 0.9 and (m.score(pos) > 0.5).mean() > 0.9
    assert quality.class_prior(pos[:1], unl[:0]) == 0.5


def test_risk_and_gradient_against_sums_over_rows():
    rnd = np.random.default_rng(2)
    for below in (False, True):
        p, u = np.c_[rnd.normal(1, 1, (30, 4)), np.ones(30)], np.c_[rnd.normal(-1, 1, (50, 4)), np.ones(50)]
        w = np.array([1.0, -0.5, 0.3, 0.2, 0.1]) if not below else np.array([3.0, 3.0, 3.0, 3.0, 0.0])
        prior = 0.4 if below else 0.1
        loss = lambda z: np.log(1 + np.exp(-z))
        part = lambda w: sum(loss(-(x @ w)) for x in u) / 50 - prior * sum(loss(-(x @ w)) for x in p) / 30  # noqa: E731, B023
        first = lambda w: prior * sum(loss(x @ w) for x in p) / 30  # noqa: E731, B023
        assert (part(w) < 0) == below
        m = quality.Model(np.zeros(4), np.ones(4), w[:4], w[4], prior)
        assert abs(quality.risk(m, p[:, :4], u[:, :4]) - first(w) - max(0, part(w))) < 1e-9
        goal = (lambda w: -part(w)) if below else (lambda w: first(w) + part(w))  # noqa: B023
        step = 1e-6
        slow = [(goal(w + step * e) - goal(w - step * e)) / (2 * step) for e in np.eye(5)]
        assert np.allclose(quality.gradient(w, p, u, prior), slow, atol=1e-5)


def test_features_see_every_part_of_a_text():
    rnd = random.Random(3)
    t = prose(rnd, 8000)
    base = quality.features(t)
    for at in range(0, len(t), len(t) // 40):
        changed = t[:at] + " $$$$ 12 <> " * 20 + t[at + 240 :]
        assert abs(quality.features(changed) - base).max() > 1e-3, at
    assert (quality.features("") == quality.features(None or "")).all()


def decoder():
    texts = [" ".join(["idiot", "stupid", "trash", "moron", "scum", "loser", "clown", "such a fool", "today"]) + " " + prose(random.Random(i), 30) for i in range(50)]
    return toxicity.Decoder(toxicity.log_model(toxicity.trigram_counts(texts).astype(float)))


def test_disguises_are_undone():
    d = decoder()
    for w, want in (("1d10t", "idiot"), ("st.u.p1d", "stupid"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("$cum", "scum"), ("stuuuupid", "stupid"), ("l-o-s-e-r", "loser"), ("idiot/moron", "idiot moron")):
        assert " ".join(d.words(w)) == want, (w, d.words(w))
    assert d.words("plain,") == ["plain"] and d.words("$$$") == [] and d.words("") == []
    for t, want in (("such a c l o w n today", ["a", "clown"]), ("an i d i o t a fool", ["idiot", "a"]), ("c l o w n s c u m", ["clown", "scum"])):
        runs, where = d.runs(*toxicity.split_words(pa.array(["", t, "a b"])))
        assert len(runs) == 1 and where.tolist() == [1]
        assert [w for w in d.restore(runs[0]).split() if w in want] == want, (t, d.restore(runs[0]))


def test_the_path_is_the_best_of_all_readings():
    d, rnd = decoder(), random.Random(6)
    S = toxicity.SYMBOLS

    def value(text):
        out = 0.0
        for w in text.split():
            x = y = 0
            for c in [*w, ""]:
                z = toxicity._CODE.get(c, toxicity._OTHER) if c else 0
                out += d.lm[(x * S + y) * S + z]
                x, y = y, z
        return out

    for _ in range(300):
        word = "".join(rnd.choice("iido10t!.s5$ p @") for _ in range(rnd.randint(1, 7)))
        readings = [("".join(x for x, _ in way), -sum(c for _, c in way)) for way in itertools.product(*d.lattice(word))]
        got = d.restore(word)
        best = max(value(t) + c for t, c in readings)
        assert abs(max(value(t) + c for t, c in readings if t == got) - best) < 1e-4, (word, got)


def test_counts_of_trigrams_against_one_by_one():
    texts, S, C = ["ab a", "", "Ünd zß 漢x", "b"], toxicity.SYMBOLS, toxicity._CODE
    want = np.zeros(S**3, np.int64)
    for t in texts:
        for w in "".join(c if c in C else " " for c in t.lower()).split():
            for x, y, z in zip([0, 0, *(C[c] for c in w)], [0, *(C[c] for c in w)], [*(C[c] for c in w), 0]):
                want[(x * S + y) * S + z] += 1
    assert (toxicity.trigram_counts(texts) == want).all()


def test_long_texts_without_spaces_take_linear_time():
    d = decoder()
    scorer = toxicity.Scorer(toxicity.Model(np.array(d.lm), {"idiot": 2.0, "idiot*": 2.0}))
    rnd = random.Random(1)
    for t in ("a" * 1_000_000, "".join(rnd.choices("abcdef0123!", k=1_000_000)), "漢" * 400_000, "." * 1_000_000, "a." * 500_000, "$" * 1_000_000):
        start = time.time()
        assert (scorer.inputs(pa.array([t]))[0] == 0).all()
        assert time.time() - start < 1.5, t[:10]
    x = scorer.inputs(pa.array(["", "you id iot", "such idioot", "i d i o t", "x" * 100 + "1d10t", "an idi ot"]))
    assert (x[:, 0] > 0).tolist() == [False, True, True, True, False, True]


def test_toxicity_on_held_out_rows_also_disguised(spark):
    rnd = random.Random(8)
    bad = ["idiot", "moron", "trash"]
    rows, labels = [(None, None, 0), (90_001, "", 0), (90_002, "ther " * 30_000, 0)], []
    for i in range(600):
        toxic = rnd.random() < 0.3
        rows.append((i, prose(rnd, 40, rnd.choices(bad, k=3) if toxic else ()), 0))
        labels.append((i, 1, int(toxic)))
    rows += [(100_000 + i, prose(rnd, 40, ("1d1ot", "m0ron", "tr4sh", "i d i o t")), 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = {r.doc_id: r for r in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows)
    test = [(i, y) for i, _, y in labels if got[i].held_out]
    assert auc([got[i].score for i, _ in test], [y for _, y in test]) > 0.98
    assert all(got[100_000 + i].predicted == 1 for i in range(5))
    assert got[90_001].predicted == got[90_002].predicted == 0
    plain = {r.doc_id: r.score for r in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), channel=False).collect()}
    assert all(plain[100_000 + i] < 0.5 for i in range(5))
    assert toxicity.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []


def test_compression_is_of_the_whole_text():
    rnd = random.Random(5)
    varied = lambda n: "".join(rnd.choices("abcdefghijklmnop qrstuvwxyz", k=n))
    same = "spam spam " * 600
    last = lambda t: quality.features(t)[-1]
    for size in (5_000, 12_000):
        plain = varied(size)
        assert last(plain + same) < 0.8 * last(plain)
        assert last(same + plain) < 0.8 * last(plain)
        assert last(same[:size] + plain + same) < 0.8 * last(plain)
