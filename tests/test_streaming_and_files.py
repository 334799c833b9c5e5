import datetime as dt

from scriptorium.functions import offsets, sql
from scriptorium.operators import bib
from scriptorium.sources import files
from scriptorium.streaming import edits


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_bursts_stream_and_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    ms = lambda n: t + dt.timedelta(milliseconds=n)
    rows = [(1, ms(0), "a"), (1, ms(200), "b"), (1, ms(900), "c"), (2, ms(100), "x"), (9, ms(60_000), "end")]
    df = spark.createDataFrame(rows, "doc_id long, ts timestamp, text string")
    want = {(1, "b", 2), (1, "c", 1), (2, "x", 1)}
    assert {(r.doc_id, r.text, r.edits) for r in edits.bursts(df).collect()} == want | {(9, "end", 1)}
    df.where("doc_id < 9").coalesce(1).write.parquet(f"{tmp_path}/e")
    df.where("doc_id = 9").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    got = {(r.doc_id, r.text, r.edits) for r in drained(edits.bursts(stream), "bursts").collect()}
    assert want <= got | want and got <= want | {(9, "end", 1)}


def test_newest_version_of_each_document(spark, tmp_path):
    schema = "doc_id long, version long, text string"
    for n, rows in enumerate([[(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], [(1, 2, "old"), (2, 2, "y")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/v/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/v")
    got = sorted((r.doc_id, r.version) for r in drained(edits.newest(stream), "newest").collect())
    assert (1, 3) in got and (2, 2) in got and (1, 2) not in got[:1]


def test_keys_checked_against_a_table(spark):
    e = spark.createDataFrame([(1, "[@a; @b] @c:1"), (2, "none")], "doc_id long, text string")
    b = spark.createDataFrame([("a",)], "key string")
    assert {(r.doc_id, r.cited) for r in edits.check_keys(e, b).collect()} == {(1, "b"), (1, "c:1")}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# X\n\né\n")
    (tmp_path / "a" / "y.txt").write_text("no")
    df = files.read_text(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in df.collect()] == [("x.md", "# X\n\né\n")]
    files.write_text(df, f"{tmp_path}/out")
    try:
        files.write_text(df, f"{tmp_path}/out")
        raise AssertionError("an existing output must stand in the way")
    except Exception as e:
        assert "exists" in str(e)
    files.write_text(df, f"{tmp_path}/out", force=True)


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "markdown_blocks" in names
    assert spark.sql("SELECT strip_marks('a {++b++} {>>c<<}') AS x").first().x == "a b"
    rows = spark.sql("SELECT t.id, r.start, r.end FROM VALUES (1, 'a `b` c') t(id, x), LATERAL code_regions(x) r").collect()
    assert [(r.id, r.start, r.end) for r in rows] == [(1, 2, 5)]


def test_silence_of_each_feature_ends_a_burst(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t + dt.timedelta(milliseconds=n), str(n)) for n in (0, 140, 400, 850, 1400)], "doc_id long, ts timestamp, text string")
    last = {k: sorted(r.text for r in edits.bursts(df, gap=f"{ms} milliseconds").collect()) for k, ms in edits.DEBOUNCE_MS.items()}
    assert last == {"validation": ["1400", "400", "850"], "word_count": ["1400", "850"], "decorations": ["140", "1400", "400", "850"]}


def test_spans_in_regions_and_documents_to_look_at_again(spark):
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 9, 12), (2, 0, 3)], "doc_id long, start long, end long")
    regions = spark.createDataFrame([(1, 4, 10)], "doc_id long, start long, end long")
    inside, outside = ({(r.doc_id, r.start) for r in offsets.covered(spans, regions, how=h).collect()} for h in ("left_semi", "left_anti"))
    assert inside == {(1, 3), (1, 9)} and outside == {(1, 0), (2, 0)}
    paired = spark.createDataFrame([(1, "a.bib"), (2, "b.bib"), (3, "a.bib")], "doc_id long, bib_id string")
    changed = spark.createDataFrame([("a.bib",), ("a.bib",), ("c.bib",)], "bib_id string")
    assert sorted(r.doc_id for r in bib.affected(changed, paired).collect()) == [1, 3]
