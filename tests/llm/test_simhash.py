import random

import numpy as np
import xxhash

from scriptorium.llm import simhash
from scriptorium.llm.components import components


def brute(prints: dict[int, int], distance=4) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_position_sets_are_hit_by_any_four_positions():
    import itertools

    for wide, n in ((False, 20), (True, 70)):
        sets = simhash.position_sets(wide)
        assert len(sets) == n
        assert all(any(set(s) <= set(f) for s in sets) for f in itertools.combinations(range(8), 4))


def test_fingerprint_by_its_definition():
    text = "The  Cat\tsat on é MAT\x0bagain"
    w = "the cat sat on é mat again".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(4)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(" \n") == 0


def _linked(spark, values, dense):
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long").repartition(5)
    edges = simhash.link(df, dense=dense)
    got = {r.node: r.root for r in components(edges).collect()}
    want = brute({int(np.uint64(v).astype(np.int64)): v for v in values})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    full = {k: got.get(k, k) for k in want}
    assert groups(full) == groups(want)


def test_links_against_brute_force_with_and_without_dense_lists(spark):
    rnd = random.Random(5)
    values = {0, 1, 31}
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(12):
            v = base
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
    _linked(spark, sorted(values), 4096)
    _linked(spark, sorted(values), 3)


def test_query_with_nulls_ties_and_repeats(spark):
    rows = [(5, "a b c d e", "x"), (3, "a b c d e", "x"), (3, "a b c d e", "x"), (None, None, "x"), (9, "", "x"), (8, "completely other words here now", "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 9), (3, 3), (3, 3), (5, 3), (8, 8), (9, 9)]
    assert {r.fingerprint for r in got if r.doc_id in (None, 9)} == {"0" * 16}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r.root for r in components(edges).collect()} == {0}


def test_components_with_and_without_broadcasts_and_with_few_tasks_a_round(spark):
    rnd = random.Random(7)
    pairs = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(200)] + [(500, i) for i in range(501, 560)] + [(600, 600), (5, 5), (4, 3)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for u, v in pairs:
        if u != v:
            a, b = sorted((find(u), find(v)))
            up[b] = a
    edges = spark.createDataFrame(pairs, "u long, v long")
    for most in (0, 10**6):
        rows = components(edges, most).collect()
        assert len(rows) == len(up) and {r.node: r.root for r in rows} == {i: find(i) for i in up}
    assert components(edges.where("u = v")).count() == 0

    # Of stars nothing is left to do, and what a round costs the driver are its tasks.
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")

    def tasks(pairs):
        group = f"components-{len(pairs)}"
        df = spark.createDataFrame(pairs, "u long, v long")
        sc.setJobGroup(group, group)
        components(df)
        seen = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return sum(i.numCompletedTasks for s in seen if (i := tracker.getStageInfo(s)))

    try:
        star, path = tasks([(0, i) for i in range(1, 60)]), tasks([(i, i + 1) for i in range(3)])
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert star < 4 * 40 and path < 15 * 40


def test_linked_rows_have_the_components_of_all_close_rows(spark):
    rnd = random.Random(6)
    prints = {}
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(10):
            v = base
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                v ^= 1 << b
            for _ in range(rnd.choice([1, 1, 3])):
                prints[rnd.getrandbits(40)] = v
    rows = spark.createDataFrame([(k, int(np.uint64(v).astype(np.int64))) for k, v in prints.items()], "key long, fp long").repartition(5)
    for dense in (4096, 3):
        pairs = simhash.linked_rows(rows, dense=dense).collect()
        assert len(pairs) <= 2 * len(prints) and all(p.u < p.v for p in pairs)
        got = {r.node: r.root for r in components(spark.createDataFrame(pairs)).collect()}
        assert {k: got.get(k, k) for k in prints} == brute(prints)
    assert simhash.linked_rows(spark.createDataFrame([], "key long, fp long")).collect() == []


def test_fingerprints_of_all_lengths(spark):
    for n in (1, 3, 4, 5, 32_771, 32_772, 70_000):
        w = [f"w{i % 977}".encode() for i in range(n)]
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, n - 3))]
        assert simhash.fingerprint(b" ".join(w).decode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
