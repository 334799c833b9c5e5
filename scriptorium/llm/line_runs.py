"""Line deduplication over levelled sorted runs of line digests.

A store of runs counts in how many documents each line stands. It takes documents batch by batch: the
batch's digests are merge-anti-joined with the digests that are *settled* (known to stand in ``least``
documents, so more of them say nothing), the rest are summed and added as a sorted run of the lowest
level. When a level has ``fan_in`` runs, these are compacted into one run of the next level, and digests
that reach ``least`` there become settled. So a batch never touches the texts of those before it, every
digest is rewritten once a level, and lines that half of a corpus has stop moving early. After the last
batch all runs are compacted, and a second pass over the texts drops the lines whose digest is settled.

Equality: a line's key is the line without white space (space, U+0009 to U+000D) at both ends and with
A-Z in lower case; keys are told by 128-bit BLAKE2b digests (of 10^12 distinct lines, a pair meets by
chance with a probability below 2^-48). Lines end at ``\\n`` only; a null or empty text is one empty
line. A document is a row: rows that share an identifier, or have none, count and are treated each by
their own text, and rows with equal texts count as often as they occur. A key that a document has twice
counts once for it. Keys shorter than ``min_chars`` code points are never dropped. A document that loses
all its lines keeps an empty text. Tables without rows give no rows; columns other than the two named
are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove, ship, text_of, work_dir
from .pieces import byte_slices

WHITE = b" \t\n\x0b\x0c\r"
MAX_BROADCAST = 500_000
SLICE = 4_000_000


def line_key(line: bytes) -> bytes:
    """The key of a line in UTF-8."""
    return line.strip(WHITE).lower()  # of bytes only A-Z have another case


def long_enough(key: bytes, chars: int) -> bool:
    """Whether a key has as many code points; those are the bytes that don't continue another."""
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode()) >= chars)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def keys_of(text: str) -> list[bytes]:
    return [line_key(x) for x in text.encode().split(b"\n")]


class LineRuns:
    """The store: levels of sorted runs ``key, n``, and runs of settled keys.

    Runs are tables in the shared folder, so a lost executor loses none, and they can be far larger than
    a machine. ``add`` takes ``key, n`` rows of a batch: keys of lines and the number of its documents
    that have them (keys may repeat).
    """

    def __init__(self, spark: SparkSession, least: int = 10, fan_in: int = 3):
        self.spark, self.least, self.fan_in = spark, least, fan_in
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def _known(self) -> DataFrame | None:
        out = None
        for s in self.settled:
            out = s if out is None else out.unionByName(s)
        return out

    def _run(self, rows: DataFrame) -> DataFrame:
        """Rows that are not settled yet, summed, as a sorted run."""
        known = self._known()
        fresh = rows if known is None else rows.join(known.hint("merge"), "key", "left_anti")
        return cut(fresh.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"), "line-run")

    def _compacted(self, runs: list[DataFrame]) -> DataFrame:
        whole = runs[0]
        for r in runs[1:]:
            whole = whole.unionByName(r)
        out = self._run(whole)
        for r in runs:
            remove(r)
        full = cut(out.where(F.col("n") >= self.least).select("key"), "line-settled")  # sorted as the run is
        self.settled.append(full)
        if len(self.settled) > self.fan_in:
            merged = cut(self._known().sortWithinPartitions("key"), "line-settled")  # runs of settled keys have none in common
            for s in self.settled:
                remove(s)
            self.settled = [merged]
        return out

    def add(self, rows: DataFrame) -> None:
        """Merge-anti-join a batch with the settled runs and add what is left as a run of its own."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._run(rows))
        i = 0
        while i < len(self.levels) and len(self.levels[i]) >= self.fan_in:
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._compacted(self.levels[i]))
            self.levels[i] = []
            i += 1

    def frequent(self) -> DataFrame:
        """``key`` of all lines that stand in ``least`` documents; compacts all runs."""
        runs = [r for level in self.levels for r in level]
        if runs:
            self.levels = [[self._compacted(runs)]]
        known = self._known()
        return known if known is not None else self.spark.createDataFrame([], "key binary")

    def close(self) -> None:
        """Remove the runs; the result of ``frequent`` must have been read."""
        for r in [*self.settled, *(r for level in self.levels for r in level)]:
            remove(r)


def _digests(batches_of: int, min_chars: int):
    """Digests of a text's keys, with the number of a slice's documents that have them and the batch of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() % batches_of
        for b in batches:
            for lo, hi in byte_slices(b.column(0), SLICE):
                n: Counter[bytes] = Counter()
                for text in b.column(0).slice(lo, hi - lo).to_pylist():
                    n.update({digest(k) for k in set(keys_of(text)) if long_enough(k, min_chars)})
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(n), pa.int32()), pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], ["batch", "key", "n"])

    return run


def frequent_lines(docs: DataFrame, text_col: str = "text", least: int = 10, min_chars: int = 1, batches: int = 6, fan_in: int = 3) -> DataFrame:
    """``key``: digests of the lines that stand in ``least`` documents or more, from a store that takes ``docs`` in ``batches``.

    The texts are read once: their digests are written by batch (a batch is a set of input partitions),
    and each batch is read from there.
    """
    spark = docs.sparkSession
    ship(spark)
    path = work_dir(spark, "line-digests")
    docs.select(text_of(text_col).alias("text")).mapInArrow(_digests(batches, min_chars), "batch int, key binary, n long").write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("batch int, key binary, n long").parquet(path)
    store = LineRuns(spark, least, fan_in)
    for i in range(batches):
        store.add(rows.where(F.col("batch") == i).select("key", "n"))
    out = cut(store.frequent(), "line-frequent")
    store.close()
    remove(path)
    return out


def _without(sent):
    """``doc_id, text, n_lines, n_dropped`` from ``doc_id, text``, by a set of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = sent.value
        for b in batches:
            for lo, hi in byte_slices(b.column(1), SLICE):
                ids, texts, lines, dropped = b.column(0).slice(lo, hi - lo), [], [], []
                for text in b.column(1).slice(lo, hi - lo).to_pylist():
                    raw = text.encode().split(b"\n")
                    kept = [x for x in raw if digest(line_key(x)) not in gone]
                    texts.append(b"\n".join(kept).decode())
                    lines.append(len(raw))
                    dropped.append(len(raw) - len(kept))
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sha, key, at`` of each line of ``sha, text``."""
    for b in batches:
        for lo, hi in byte_slices(b.column(1), SLICE):
            sha, key, at = [], [], []
            for s, text in zip(b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist()):
                keys = keys_of(text)
                sha += [s] * len(keys)
                key += map(digest, keys)
                at += range(len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(key, pa.binary()), pa.array(at, pa.int64())], ["sha", "key", "at"])


def _joined(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """As ``_without``, for any number of digests: places of lines that go are joined to the texts by the texts' digests."""
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    gone = rows.select("sha", "text").mapInArrow(_places, "sha binary, key binary, at long").join(frequent, "key", "left_semi")
    gone = gone.groupBy("sha").agg(F.collect_set("at").alias("gone"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", i.cast("long")))
    both = rows.join(gone, "sha", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))
    return both.select("doc_id", F.array_join(kept, "\n").alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))


def without_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 10,
    min_chars: int = 1,
    batches: int = 6,
    fan_in: int = 3,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of each row of ``docs``: texts without the lines that ``least`` documents have.

    Up to ``max_broadcast`` digests of such lines are sent to the texts; more are joined.
    """
    spark = docs.sparkSession
    gone = frequent_lines(docs, text_col, least, min_chars, batches, fan_in)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if gone.count() > max_broadcast:
        return _joined(rows, gone)
    sent = spark.sparkContext.broadcast(frozenset(bytes(r.key) for r in gone.toLocalIterator()))
    remove(gone)
    return rows.mapInArrow(_without(sent), "doc_id long, text string, n_lines long, n_dropped long")
