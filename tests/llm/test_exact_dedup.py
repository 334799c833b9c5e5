import hashlib
import random

from scriptorium.llm.exact_dedup import exact_duplicates, merge_tree

SCHEMA = "doc_id long, text string, sha string, owner int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA).repartition(parts)


def test_largest_identifier_stays_and_counts_are_whole(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 5 + [None, "", "a", "b", f"own {i}"])) for i in range(400)]
    want = {}
    for i, t in rows:
        want.setdefault(t or "", []).append(i)
    for fan_in, rounds in ((16, None), (2, 3), (4, 1)):
        got = {r.doc_id: r for r in exact_duplicates(frame(spark, rows), fan_in=fan_in, rounds=rounds).collect()}
        assert len(got) == 400
        for t, ids in want.items():
            for i in ids:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_smallest_identifier_nulls_and_repeated_rows(spark):
    rows = [(None, "x"), (4, "x"), (4, "x"), (9, "x"), (None, "y")]
    got = exact_duplicates(frame(spark, rows), keep="min").collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (9, 4, 4, False)]


def test_empty(spark):
    assert exact_duplicates(frame(spark, [])).collect() == []


def test_runs_merge_to_one_entry_a_digest(spark):
    rows = [(bytes([d]) * 32, 3, i, 1) for i, d in enumerate([1, 2, 1, 3, 1, 2])]
    got = merge_tree(spark.createDataFrame(rows, "sha binary, bytes long, keep long, rows long").repartition(6)).collect()
    assert sorted((r.sha[0], r.keep, r.rows) for r in got) == [(1, 4, 3), (2, 5, 2), (3, 3, 1)]
