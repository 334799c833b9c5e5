"""Files that change, debouncing by timers, and diagnostics that follow changes."""

import os
import random
import time

import pytest
from pyspark.sql import Row

from scriptorium.sources import watched
from scriptorium.streaming.debounce import Debounce, debounced
from scriptorium.streaming.workspace import Workspace


def save(folder, name, text):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


class Collected:
    """A stream's micro-batches."""

    def __init__(self, df, checkpoint):
        self.batches = []
        self.query = df.writeStream.foreachBatch(lambda b, n: self.batches.append(sorted((os.path.basename(r.path), r.change, r.text) for r in b.collect()))).option("checkpointLocation", str(checkpoint)).start()

    def next(self):
        self.query.processAllAvailable()
        out, self.batches = [x for b in self.batches for x in b], []
        return out


@pytest.mark.parametrize("kept", [False, True])
def test_files_that_come_change_and_go_between_batches(spark, tmp_path, kept):
    folder, checkpoint = tmp_path / "ws", tmp_path / "checkpoint"
    state = str(tmp_path / "listings") if kept else None
    save(folder, "a.md", "one")
    save(folder, "below/b.md", "two")
    save(folder, "c.txt", "not asked for")
    s = Collected(watched.watch(spark, str(folder), "*.md,*.bib", state), checkpoint)
    assert s.next() == [("a.md", "added", "one"), ("b.md", "added", "two")]
    save(folder, "a.md", "one, again")
    (folder / "below" / "b.md").unlink()
    save(folder, "d.bib", "@misc{d,}")
    assert s.next() == [("a.md", "changed", "one, again"), ("b.md", "deleted", None), ("d.bib", "added", "@misc{d,}")]
    assert s.next() == []
    os.utime(folder / "a.md", ns=(1, 1))
    assert s.next() == [("a.md", "changed", "one, again")]
    s.query.stop()
    save(folder, "a.md", "while nobody looked")
    (folder / "d.bib").unlink()
    s = Collected(watched.watch(spark, str(folder), "*.md,*.bib", state), checkpoint)  # goes on where it stopped
    assert s.next() == [("a.md", "changed", "while nobody looked"), ("d.bib", "deleted", None)]
    s.query.stop()


def test_a_batch_read_has_what_is_there(spark, tmp_path):
    save(tmp_path, "a.md", "é")
    (tmp_path / "b.md").write_bytes(b"\xff\n")
    rows = watched.present(spark, str(tmp_path), "*.md").collect()
    assert sorted((os.path.basename(r.path), r.change, r.size, r.text) for r in rows) == [("a.md", "added", 2, "é"), ("b.md", "added", 2, "�\n")]
    assert watched.present(spark, str(tmp_path / "missing")).collect() == []


def test_listings_differ():
    old, new = {"a": "1:5", "b": "1:5", "c": "1:1"}, {"a": "1:5", "b": "2:5", "d": "9:0"}
    assert watched.changes(old, new) == [("b", "changed", "2:5"), ("c", "deleted", "1:1"), ("d", "added", "9:0")]
    rows = [(str(i), "added", f"1:{i * 1000}") for i in range(50)]
    parts = watched.dealt(rows, 100_000)
    assert [r for p in parts for r in p] == rows and all(len(p) == 1 or sum(int(r[2][2:]) + 4096 for r in p) <= 100_000 for p in parts)


class Handle:
    """State and timers of one document, under a clock that the test sets."""

    def __init__(self):
        self.timers, self.values, self.maps = set(), {}, {}

    def getValueState(self, name, schema, ttl=None):
        h = self

        class Value:
            exists = staticmethod(lambda: name in h.values)
            get = staticmethod(lambda: h.values[name])
            update = staticmethod(lambda v: h.values.__setitem__(name, v))
            clear = staticmethod(lambda: h.values.pop(name, None))

        return Value

    def getMapState(self, name, k, v, ttl=None):
        m = self.maps.setdefault(name, {})

        class Map:
            containsKey = staticmethod(m.__contains__)
            getValue = staticmethod(m.get)
            updateValue = staticmethod(m.__setitem__)
            clear = staticmethod(m.clear)

        return Map

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def simulate(edits, gaps, forget=None, until=10_000):
    """Edits ``(arrives at, version, text)`` of one document under a simulated clock; what ran: ``(at, feature, version, edits, stale)``."""
    p, h, out = Debounce(gaps, forget), Handle(), []
    p.init(h)
    todo = sorted(edits, key=lambda e: e[0])
    while todo or h.timers:
        t = min([x[0] for x in todo] + list(h.timers))
        if t > until:
            break
        due = [x for x in todo if x[0] == t]
        todo = [x for x in todo if x[0] != t]
        if due:
            list(p.handleInputRows((7,), iter([Row(doc_id=7, version=v, text=s) for _, v, s in due]), Clock(t)))
        if t in h.timers:
            h.timers.discard(t)
            out += [(t, r.feature, r.version, r.edits, r.stale, r.text) for r in p.handleExpiredTimer((7,), Clock(t), Clock(t))]
    return out, h


GAPS = {"validation": 300, "word_count": 500, "decorations": 150}


def test_each_feature_waits_for_its_own_silence():
    edits = [(0, 1, "a"), (100, 2, "b"), (300, 3, "c"), (700, 4, "d")]
    out, h = simulate(edits, GAPS)
    assert [x[:3] for x in out] == [(250, "decorations", 2), (450, "decorations", 3), (600, "validation", 3), (850, "decorations", 4), (1000, "validation", 4), (1200, "word_count", 4)]
    assert not h.timers and h.values["newest"][1] is None


def test_old_versions_start_no_silence_and_never_come_back():
    edits = [(0, 5, "five"), (290, 3, "late"), (310, 5, "again"), (400, 4, "late"), (9_000, 2, "very late"), (9_100, 6, "six")]
    out, _ = simulate(edits, {"validation": 300})
    assert [(t, v, s) for t, _, v, _, _, s in out] == [(300, 5, "five"), (9_400, 6, "six")]
    assert out[0][3:5] == (1, 1)


def test_forgotten_documents_start_anew():
    out, h = simulate([(0, 5, "five"), (2_000, 3, "three")], {"validation": 300}, forget=1_000, until=2_900)
    assert [(t, v) for t, _, v, *_ in out] == [(300, 5), (2_300, 3)]
    _, h = simulate([(0, 5, "five")], {"validation": 300}, forget=1_000)
    assert not h.values and not h.timers


def test_many_random_orders_against_a_plain_simulation():
    r = random.Random(5)
    for _ in range(60):
        edits = [(r.randrange(0, 4_000), r.randrange(1, 12), "x") for _ in range(r.randrange(1, 14))]
        gap = r.choice([100, 300])
        out, _ = simulate(edits, {"f": gap})
        want, newest, last = [], None, None
        moments = sorted({t for t, *_ in edits})
        for t in moments + [10**6]:
            if last is not None and last + gap < t or last is not None and last + gap == t and not any(e[0] == t and e[1] > newest for e in edits):
                want.append((last + gap, newest))
                last = None
            for v in sorted(e[1] for e in edits if e[0] == t):
                if newest is None or v > newest:
                    newest, last = v, t
        assert [(t, v) for t, _, v, *_ in out] == want


def test_debounce_on_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "doc_id long, version long, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    put([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")])
    stream = debounced(spark.readStream.schema(schema).parquet(f"{tmp_path}/e"), {"validation": 200})
    q = stream.writeStream.format("memory").queryName("debounced").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="300 milliseconds").start()
    got = lambda: {(r.doc_id, r.version, r.text) for r in spark.table("debounced").collect()}
    try:
        for want in ({(1, 2, "b"), (2, 1, "x")}, {(1, 2, "b"), (2, 1, "x"), (3, 1, "z")}):
            end = time.time() + 90
            while got() != want and time.time() < end:
                time.sleep(0.3)
            assert got() == want
            put([(1, 1, "old"), (3, 1, "z")])
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def cites(*keys):
    return "text " + " ".join(f"[@{k}]" for k in keys) + " `[@code]`"


def front(bib, text):
    return f"---\nbibliography: {bib}\n---\n{text}"


def bibs(*keys):
    return "\n".join(f"@misc{{{k},\n title = {{t}}\n}}" for k in keys)


class Model:
    """What the diagnostics must be, from all files."""

    def __init__(self, roots):
        self.files, self.roots = {}, roots

    def bib_of(self, path, text):
        named = text.split("\n")[1].partition(": ")[2] if text.startswith("---") else ""
        places = []
        if named:
            named = named if named.endswith(".bib") else named + ".bib"
            if named.startswith("/"):
                places = [r + named for r in self.roots] + [named]
            else:
                places = [os.path.dirname(path) + "/" + named] + [f"{r}/{named}" for r in self.roots]
        return next((p for p in [*places, path[:-3] + ".bib"] if p in self.files), None)

    def want(self):
        out = set()
        for path, text in self.files.items():
            if path.endswith(".md") and (b := self.bib_of(path, text)):
                known = {x.partition("{")[2].partition(",")[0] for x in self.files[b].split("@")[1:]}
                for part in text.split("[@")[1:]:
                    key = part.partition("]")[0]
                    if key not in known and key != "code":
                        out.add((path, key))
        return out


def apply(spark, ws, model, batch, changed):
    rows = []
    for path, text in changed.items():
        rows.append((path, "deleted" if text is None else "changed" if path in model.files else "added", text))
        if text is None:
            model.files.pop(path, None)
        else:
            model.files[path] = text
    df = spark.createDataFrame(rows, "path string, change string, text string")
    ws.apply(df, batch)
    return df


def state(ws):
    return {(r.path, r.key) for r in ws.diagnostics().collect()}


def test_only_what_a_change_concerns_is_looked_at_again(spark, tmp_path):
    ws, m = Workspace(spark, f"file://{tmp_path}/s", ["/w"], compact=0), Model(["/w"])
    checked = lambda n: {r.path for r in spark.read.parquet(f"{tmp_path}/s/parts/batch={n}/checked").collect()}
    first = {"/w/a.md": front("x", cites("k1", "k2")), "/w/b.md": front("x", cites("k3")), "/w/c.md": cites("k1"), "/w/x.bib": bibs("k1"), "/w/d/e.md": front("/x.bib", cites("k9"))}
    apply(spark, ws, m, 0, first)
    assert state(ws) == m.want() == {("/w/a.md", "k2"), ("/w/b.md", "k3"), ("/w/d/e.md", "k9")}
    df = apply(spark, ws, m, 1, {"/w/x.bib": bibs("k1", "k3")})
    assert state(ws) == m.want() == {("/w/a.md", "k2"), ("/w/d/e.md", "k9")}
    assert checked(1) == {"/w/a.md", "/w/b.md", "/w/d/e.md"}
    ws.apply(df, 1)  # replayed
    assert state(ws) == m.want()
    apply(spark, ws, m, 2, {"/w/c.bib": bibs("k2")})  # a document whose bibliography was not there before
    assert checked(2) == {"/w/c.md"} and ("/w/c.md", "k1") in state(ws) and state(ws) == m.want()
    apply(spark, ws, m, 3, {"/w/a.md": None, "/w/c.bib": None})
    assert state(ws) == m.want() == {("/w/d/e.md", "k9")}
    apply(spark, ws, m, 4, {"/w/d/x.bib": bibs("k9"), "/w/d/e.md": front("x", cites("k9", "k1"))})
    assert state(ws) == m.want() == {("/w/d/e.md", "k1")}
    at = ws.diagnostics().first()
    assert m.files["/w/d/e.md"][at.start : at.end] == "k1"


def test_random_changes_with_replays_and_bases(spark, tmp_path):
    r = random.Random(3)
    ws, m = Workspace(spark, f"file://{tmp_path}/s", ["/w"], compact=3), Model(["/w"])
    for batch in range(8):
        changed = {}
        for _ in range(4):
            if r.random() < 0.5:
                path = f"/w/{r.choice('pq')}/{r.choice('abcd')}.md"
                text = cites(*r.choices(["k1", "k2", "k3", "k4"], k=2))
                changed[path] = None if r.random() < 0.2 and path in m.files else front(r.choice(["x", "/x", "y"]), text) if r.random() < 0.7 else text
            else:
                path = r.choice(["/w/x.bib", "/w/p/x.bib", "/w/y.bib", "/w/p/a.bib", "/w/q/b.bib"])
                changed[path] = None if r.random() < 0.3 and path in m.files else bibs(*r.sample(["k1", "k2", "k3", "k4"], 2))
        df = apply(spark, ws, m, batch, changed)
        if batch in (2, 5, 6):  # also one that made a base
            Workspace(spark, f"file://{tmp_path}/s", ["/w"], compact=3).apply(df, batch)
        assert state(ws) == m.want(), batch
    assert len(os.listdir(tmp_path / "s" / "parts")) < 8


def test_a_followed_folder(spark, tmp_path):
    folder = tmp_path / "w"
    save(folder, "a.md", front("x", cites("k1")))
    save(folder, "x.bib", bibs("k2"))
    ws = Workspace(spark, f"file://{tmp_path}/s", [str(folder)])
    q = ws.follow(watched.watch(spark, str(folder)), f"{tmp_path}/c", processingTime="200 milliseconds")
    q.processAllAvailable()
    assert {k for _, k in state(ws)} == {"k1"}
    save(folder, "x.bib", bibs("k2", "k1"))
    q.processAllAvailable()
    assert state(ws) == set()
    q.stop()


def test_a_bibliography_may_come_in_pieces(spark, tmp_path):
    schema = "path string, change string, text string, piece long"
    ws = Workspace(spark, f"file://{tmp_path}/s", ["/w"])
    doc = ("/w/a.md", "added", front("x", cites("k1", "k2", "k3", "k4")), None)
    ws.apply(spark.createDataFrame([doc, ("/w/x.bib", "added", bibs("k1"), 7), ("/w/x.bib", "added", bibs("k2", "k9"), 8), ("/w/x.bib", "added", "", None)], schema), 0)
    assert state(ws) == {("/w/a.md", "k3"), ("/w/a.md", "k4")}
    ws.apply(spark.createDataFrame([("/w/x.bib", "changed", bibs("k4"), 1), ("/w/x.bib", "changed", bibs("k3"), 2), ("/w/x.bib", "deleted", None, None)], schema), 1)
    assert state(ws) == {("/w/a.md", "k1"), ("/w/a.md", "k2")}
    ws.apply(spark.createDataFrame([("/w/x.bib", "deleted", None, None)], schema), 2)
    assert state(ws) == set()
    assert not [d for d, *_ in os.walk(tmp_path / "s") if d.endswith("/changes")]  # no text is kept


def test_no_row_of_a_bibliography_grows_with_the_parts(spark, tmp_path):
    from scriptorium.plans import changes

    longest = []
    for n in (2_000, 20_000):
        spark.range(n).selectExpr("CAST(id AS INT) AS p_partkey").write.parquet(f"{tmp_path}/{n}/part.parquet")
        rows = changes._bib(spark, f"{tmp_path}/{n}", "/ws/x.bib", "p_partkey % 7 <> 3").collect()
        longest.append(max(len(r.text) for r in rows))
        assert sum(r.text.count("@misc") for r in rows) == sum(k % 7 != 3 for k in range(n))
    assert longest[1] < longest[0] * 1.5
