import hashlib
from collections import Counter

import pytest

from scriptorium.llm.line_runs import LineRuns, digest, frequent_lines, line_key, without_frequent_lines

WHITE = " \t\n\x0b\x0c\r"


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(texts: list[str | None], least: int = 10, min_chars: int = 1) -> list[tuple[str, int, int]]:
    lines = [(t or "").split("\n") for t in texts]
    keys = [[lower(x.strip(WHITE)) for x in d] for d in lines]
    df = Counter(k for d in keys for k in set(d))
    gone = {k for k, n in df.items() if n >= least and len(k) >= min_chars}
    out = []
    for d, k in zip(lines, keys):
        kept = [x for x, y in zip(d, k) if y not in gone]
        out.append(("\n".join(kept), len(d), len(d) - len(kept)))
    return out


TEXTS = (
    [f"Head\n  SHARED line \nown {i}\n\nshared LINE" for i in range(7)]
    + [f"shared line\t\nÄrger\n{i}" for i in range(5)]
    + [f"ärger\nonly nine\r" for _ in range(9)]
    + ["only nine \x0b", "x\n" * 50, "", None, "\n\n", "Ärger", "shared line", " wide ", "wide", "a\u0000b"]
    + ["many lines\n" + "\n".join(f"line {j}" for j in range(3000))]
    + ["z" * 300_000]
)


@pytest.mark.parametrize("least, min_chars, batches, fan_in, most", [(10, 1, 6, 3, 10), (2, 4, 4, 2, 10), (10, 1, 3, 2, 0), (3, 1, 1, 3, 0), (5, 1, 7, 2, 10)])
def test_equals_brute_force(spark, least, min_chars, batches, fan_in, most):
    df = spark.createDataFrame([(i // 2 if i % 9 else None, t, "x", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, key string, n long").repartition(6)
    out = without_frequent_lines(df, least=least, min_chars=min_chars, batches=batches, fan_in=fan_in, max_broadcast=most)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in out.collect())
    ids = [i // 2 if i % 9 else None for i in range(len(TEXTS))]
    assert got == sorted((i is None, i or 0, *x) for i, x in zip(ids, brute(TEXTS, least, min_chars)))


def test_store_takes_batches_one_after_another(spark):
    store = LineRuns(spark, least=4, fan_in=2)
    total = Counter()
    for b in range(9):
        rows = [(digest(f"k{k}".encode()), 1 + (k + b) % 2) for k in range(40) if (k * 7 + b) % 5 < 1 + k % 4]
        total.update(dict())
        for k, n in rows:
            total[k] += n
        store.add(spark.createDataFrame(rows, "key binary, n long"))
        assert sum(map(len, store.levels)) <= 6
    assert {bytes(r.key) for r in store.frequent().collect()} == {k for k, n in total.items() if n >= 4}
    store.close()


def test_settled_keys_are_counted_no_more(spark):
    store = LineRuns(spark, least=3, fan_in=2)
    hot = digest(b"hot")
    for _ in range(2):
        store.add(spark.createDataFrame([(hot, 5)], "key binary, n long"))
    store.add(spark.createDataFrame([(hot, 5), (digest(b"new"), 1)], "key binary, n long"))
    assert [bytes(r.key) for r in store.levels[0][0].collect()] == [digest(b"new")]
    assert [bytes(r.key) for r in store.frequent().collect()] == [hot]


def test_keys():
    assert line_key("\t ÀB c\x0b".encode()) == "Àb c".encode()
    assert line_key(" a".encode()) == " a".encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert without_frequent_lines(df).collect() == []
    assert frequent_lines(df).collect() == []


def test_query_on_the_given_documents(spark):
    from scriptorium.llm.queries import op13_line_runs

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows]))}
    for r in op13_line_runs(spark, "/root/testdata/sf0.001").collect():
        text, lines, dropped = want.pop(r.doc_id)
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (lines, dropped, hashlib.sha256(text.encode()).hexdigest())
    assert not want
