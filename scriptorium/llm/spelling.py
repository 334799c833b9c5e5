"""Spelling variants: words at edit distance one, and the form that a rare one stands for.

The vocabulary is joined with itself on tries. A trie is walked from its root; with each node goes its
set of *active nodes*, those within distance one of it, which follows from the parent's set: the parent
itself (a letter more), its other children (a letter replaced), the children of the node's own counterpart
(a letter less), and of each active node the child by the same letter. Where a word ends, the words that
end at active nodes are its near words.

The vocabulary is dealt into tries by what words share. Two near words of ``l`` and ``l`` or ``l + 1`` code
points share their first ``l // 2`` code points, or else their last ``l - l // 2``; so each word goes to the trie of
its first half and, read backwards, to that of its second half, in the class of its own length and in that of
words one shorter. A trie of over ``GROUP`` words is dealt again in the same way by halves of what its
words do not share yet, until at most two code points differ, of which there are only so many. Pairs
belong to the trie of the prefix if they share it, so no pair is found twice. A walk's near words of a word
are summed where they are found; pairs never leave a task.

Words are counted over whole texts: maximal runs of ASCII letters and U+00C0 to U+00FF (null: none),
A-Z in lower case. With ``drop=31`` (0: no changes) a run of a document, whose CRC-32 ``h`` of ``doc_id:run``
is divisible by 31, loses its code point ``h % length``: misprints planted by rule, the same at each
occurrence in a row with that identifier (a null one is written as an empty string). Words are the results of at
least ``min_length`` code points (5 or more, else halves may be empty) that occur ``min_count`` times or more; rows
that repeat count again. A word's form is its most frequent near word (ties: the smallest by code
points), if that is ``ratio`` times as frequent; its root is where forms lead. Counts grow tenfold with each step,
so chains are short and have no circles. Words of any length are taken whole. Empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, ship, text_of
from .pieces import byte_slices

GROUP = 5_000
HELD = 500_000

# Latin-1 has a byte for each of the letters; what is no letter ends a run.
_FOLD = bytes(i if i >= 0xC0 else ord(chr(i).lower()) if i < 128 and chr(i).isalpha() else 32 for i in range(256))


def counted(texts: Iterator[tuple[int | None, str]], drop: int, min_length: int) -> Iterator[Counter[bytes]]:
    """Words in Latin-1 and how often they occur, in parts of about ``HELD`` words."""
    n: Counter[bytes] = Counter()
    for doc_id, text in texts:
        start = crc32(b"%d:" % doc_id if doc_id is not None else b":")
        for run, k in Counter(text.encode("latin-1", "replace").translate(_FOLD).split()).items():
            if len(run) < min_length:
                continue
            if drop:
                h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                if h % drop == 0:
                    i = h % len(run)
                    run = run[:i] + run[i + 1 :]
                    if len(run) < min_length:
                        continue
            n[run] += k
        if len(n) >= HELD:
            yield n
            n = Counter()
    yield n


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``word, n`` of the whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            for b in batches:
                for lo, hi in byte_slices(b.column(1), 4_000_000):
                    yield from zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist())

        for n in counted(texts(), drop, min_length):
            for some in _parts(n):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in some], pa.string()), pa.array([k for _, k in some], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _parts(n: Counter[bytes]) -> Iterator[list[tuple[bytes, int]]]:
    """The entries, in parts of about 4 MB."""
    out, size = [], 0
    for x in n.items():
        out.append(x)
        size += len(x[0]) + 8
        if size > 4_000_000:
            yield out
            out, size = [], 0
    if out:
        yield out


class Trie:
    """Words by number; nodes by number, with their children by letter."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[list[int]] = [[]]
        for k, w in enumerate(words):
            at = 0
            for c in w:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.word)
                    self.children.append({})
                    self.word.append([])
                at = nxt
            self.word[at].append(k)

    def near(self) -> Iterator[tuple[int, int]]:
        """Pairs of words at distance one, each in both orders, by a walk with active nodes."""
        children, word = self.children, self.word
        todo: list[tuple[int, set[int]]] = [(0, set(children[0].values()))]
        while todo:
            node, active = todo.pop()
            for x in word[node]:
                for q in active:
                    for y in word[q]:
                        yield x, y
            own = children[node]
            for c, child in own.items():
                new = {children[q][c] for q in active if c in children[q]}
                new.add(node)
                new.update(own.values())
                new.update(children[child].values())
                new.discard(child)
                todo.append((child, new))


def _same_start(words: list[str]) -> int:
    """Code points that all words begin with."""
    a, b = min(words), max(words)
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def pairs(members: list[str], cls: int, lo: int, hi: int, first: int) -> Iterator[tuple[int, int]]:
    """Pairs of ``members`` at distance one, in both orders: words of ``cls`` code points with such words or words one longer.

    All members share their first ``lo`` and last ``hi`` code points. Pairs that share the first ``first`` code
    points (if above 0) belong to another trie.
    """
    if not any(len(w) == cls for w in members):
        return
    middle = [w[lo : len(w) - hi] for w in members]
    if hi:  # read from where the words differ
        middle = [w[::-1] for w in middle]
    skip = _same_start(middle)
    middle = [w[skip:] for w in middle]
    for x, y in Trie(middle).near():
        a, b = members[x], members[y]
        if (len(a) == cls or len(b) == cls) and not (first and a[:first] == b[:first]):
            yield x, y


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of what its trie does not share yet, and with the second."""
    r = F.col("cls") - F.col("lo") - F.col("hi")
    a = F.floor(r / 2).cast("int")
    way = F.explode(
        F.array(
            F.struct((F.col("lo") + a).alias("lo"), F.col("hi").alias("hi"), F.col("first").alias("first")),
            F.struct(F.col("lo").alias("lo"), (F.col("hi") + r - a).alias("hi"), (F.col("lo") + a).alias("first")),
        )
    )
    return _keyed(rows.select("word", "n", "cls", way.alias("x")).select("word", "n", "cls", "x.lo", "x.hi", "x.first"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: what the words of a trie share."""
    end: Column = F.when(F.col("hi") > 0, F.expr("right(word, hi)")).otherwise(F.lit(""))
    return rows.withColumn("key", F.concat_ws(":", "cls", "lo", "hi", F.expr("substring(word, 1, lo)"), end))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word in each trie: the number of near words, and the most frequent of them."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    for key, group in _groups(batches):
        names, n, cls, lo, hi, first = group
        best: dict[int, list] = {}
        for x, y in pairs(names, cls, lo, hi, first):
            b = best.get(x)
            if b is None:
                best[x] = [1, n[y], names[y]]
            else:
                b[0] += 1
                if n[y] > b[1] or n[y] == b[1] and names[y] < b[2]:
                    b[1:] = n[y], names[y]
        out += [(names[x], *b) for x, b in best.items()]
        if len(out) > 20_000:
            yield batch()
    if out:
        yield batch()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple]]:
    """Tries of two words or more from rows that are sorted by key."""
    held: str | None = None
    names: list[str] = []
    n: list[int] = []
    shape: tuple = ()
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for key, word, k, *rest in zip(*cols):
            if key != held:
                if len(names) > 1:
                    yield held, (names, n, *shape)
                held, names, n, shape = key, [], [], tuple(rest)
            names.append(word)
            n.append(k)
    if len(names) > 1:
        yield held, (names, n, *shape)


def near_words(vocabulary: DataFrame, min_length: int = 7, group: int = GROUP) -> DataFrame:
    """``word, n_near, best, best_n`` of the words that have near words; ``vocabulary`` has ``word, n`` (distinct, ``min_length`` code points or more)."""
    spark = vocabulary.sparkSession
    ship(spark)
    size = F.char_length("word")
    own = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("cls")).where(F.col("cls") >= min_length)
    rows = _dealt(own.select("word", "n", "cls", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("first")))
    ready, temporary = None, []
    while True:
        # A trie whose words differ in two code points at most has few words, however large the vocabulary.
        many = rows.where("cls - lo - hi > 2").groupBy("key").count().where(F.col("count") > group).select("key")
        hot = cut(many, "spelling-hot")
        temporary.append(hot)
        if not hot.limit(1).count():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        calm = rows.join(hot, "key", "left_anti")
        ready = calm if ready is None else ready.unionByName(calm)
        rows = cut(_dealt(rows.join(hot, "key", "left_semi").drop("key")), "spelling-rows")
        temporary.append(rows)
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ready.select("key", "word", "n", "cls", "lo", "hi", "first").repartition(tasks, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_found, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    out = cut(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("m")).select("word", "n_near", F.col("m.w").alias("best"), (-F.col("m.k")).alias("best_n")), "spelling-near")
    for t in temporary:
        remove(t)
    return out


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    drop: int = 31,
    min_length: int = 7,
    min_count: int = 2,
    ratio: int = 10,
    group: int = GROUP,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of the documents."""
    vocabulary = cut(words(docs, id_col, text_col, drop, min_length, min_count), "spelling-words")
    near = near_words(vocabulary, min_length, group)
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = vocabulary.join(near, "word", "left").select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = cut(rows, "spelling-forms")
    remove(vocabulary)
    remove(near)
    roots = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = rows.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """``word, root``: where links lead; each round doubles how far they are followed."""
    now = cut(links, "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        remove(now)
        now = new
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = new.drop("moved")
        now._scriptorium_path = new._scriptorium_path
