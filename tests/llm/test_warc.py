import base64
import gzip
import hashlib
import random
from base64 import b32encode
from collections import Counter
from datetime import datetime

from scriptorium.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def rows(spark, data, **k):
    df = spark.createDataFrame([(*d, "x") for d in data], SCHEMA)
    return sorted(warc.dedup_archives(df, **k).select("row_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), key=str)


def test_equal_payloads_revisit_the_largest_row(spark):
    got = {r.row_id: r for r in rows(spark, [(1, "http://a/ b", "x é"), (2, None, "x é"), (3, "u", None), (4, "u", ""), (5, "u", "y" * 100_000), (6, "u", "z\r\n\r\nWARC/1.1\r\n")])}
    assert {k: (v.record_type, v.refers_to) for k, v in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert got[1].payload_bytes == 4
    assert got[1].payload_digest == b32encode(hashlib.sha1("x é".encode()).digest()).decode()


def test_repeated_rows_null_ids_and_small_payloads(spark):
    got = rows(spark, [(7, "u", "same"), (7, "u", "same"), (None, "u", "same")])
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {7}
    assert {r.record_type for r in rows(spark, [(1, "u", "ab"), (2, "u", "ab")], min_bytes=3)} == {"response"}


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_archives_are_gzip_that_other_readers_take(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>", "x") for i in range(20)], SCHEMA)
    path = warc.write_archives(df, f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == 20
    assert warc.read_headers(spark, path).count() == 20


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    html = ["", None, "<p>a</p>", "é漢😀", "x" * 5000, "b\0\r\n\r\nWARC/1.1"]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(["http://a/", None, "http://b/ c\n"]), rnd.choice(html), "q") for _ in range(150)]
    rows += [(100 + i, "u", f"own {i}", "q") for i in range(20)] + [(500, "u", "y" * 300_000, "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    for least, limit in ((0, 100_000), (6, 100_000), (0, 0)):
        monkeypatch.setattr(warc, "MAX_BROADCAST", limit)
        got = warc.dedup_archives(df, min_bytes=least).collect()
        assert len(got) == len(rows)
        raw = [(i, (h or "").encode()) for i, _, h, _ in rows]
        want = Counter()
        for p in {p for _, p in raw}:
            ids = [i for i, x in raw if x == p]
            top = max((i for i in ids if i is not None), default=None)
            if len(p) >= least:
                ids.remove(top)
            for i in ids:
                want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if len(p) >= least else "response", top if len(p) >= least else None] += 1
            if len(p) >= least:
                want[top, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response", None] += 1
        assert Counter((r.row_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_dates_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a/", "x", datetime(2020, 5, 6, 7, 8, 9)), (2, "http://b/", "y", None)], "page_id long, url string, html string, at timestamp")
    heads = warc.read_headers(spark, warc.write_archives(df, date_col="at")).collect()
    assert {r.row_id: r.date for r in heads} == {1: "2020-05-06T07:08:09Z", 2: "1970-01-01T00:00:00Z"}
    assert warc.dedup_archives(df.limit(0)).collect() == []
