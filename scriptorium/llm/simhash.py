"""Near duplicates by SimHash, linked through an inverted index of byte positions.

Fingerprints have 64 bits, so 8 bytes at fixed positions. If two of them differ in at most
``distance`` = 4 bits, at least 4 positional bytes are the same: that is the number of matches that a
linked pair is guaranteed to reach. Posting lists of single bytes would hold a 256th of all
fingerprints each, so lists are kept for sets of positions that any 4 shared positions must include:
the 20 triples of Turan's system, or all 70 sets of four where there are over ``2**26`` distinct
fingerprints. In a list, shared positional bytes are tallied for each pair, pairs with the minimum are
retained, and their distance is verified. A list gives only as many links as join up what it found
(a spanning forest), which leaves components as they are.

Equal fingerprints are one entry, however many documents have them. A list of over ``DENSE`` entries,
which only a very large group of near copies makes, isn't paired: its fingerprints are joined through
the points within half the distance of each. Two fingerprints differ in at most 4 bits exactly if such
a point is common to both, and a point has at most 2,081 fingerprints near it.

Shingles: words are maximal runs of bytes other than space and U+0009 to U+000D after lower-casing A to
Z; fewer words than a shingle give one shingle of all; no words give fingerprint zero, which links like
any other. Null texts count as empty. Rows that repeat an identifier are rows of their own. Components
whose rows all have null identifiers have a null one. Empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, ship, text_of
from .components import MAX_BROADCAST, components

DENSE = 4096
WIDE_FROM = 2**26


def shingles(text: str, words: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of a text's shingles, uint64, repeats included; none of a text without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1) if w else 0
    return np.fromiter((h(b" ".join(w[i : i + words]), seed) for i in range(n)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The SimHash of these hashes: a bit is 1 if it is set in over half of them."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), 32_768):
        total += np.unpackbits(h[lo : lo + 32_768].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text's shingles."""
    return majority(shingles(text, words, seed))


def position_sets(wide: bool) -> list[tuple[int, ...]]:
    """Sets of byte positions, one of which any 4 of the 8 positions include."""
    if wide:
        return list(itertools.combinations(range(8), 4))
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in itertools.combinations(g, 3)]
    for i, g in enumerate(groups):
        out += [tuple(sorted((*p, x))) for p in itertools.combinations(g, 2) for x in groups[(i + 1) % 3]]
    return sorted(out)


def posting_keys(fps: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Keys of the lists that each fingerprint is in, a column for each set."""
    b = fps.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    out = np.empty((len(fps), len(sets)), np.int64)
    for j, s in enumerate(sets):
        key = np.full(len(fps), j, np.int64)
        for p in s:
            key = key << 8 | b[:, p]
        out[:, j] = key
    return out


def links_in(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within ``distance``, from one list of distinct fingerprints."""
    n, out = len(fps), []
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    least = 8 - distance
    for i in range(n - 1):
        x = fps[i + 1 :] ^ fps[i]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        at = np.flatnonzero(tally >= least)
        at = at[np.bitwise_count(x[at]) <= distance]
        for j in (at + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((i, j))
    return out


def ball(radius: int) -> np.ndarray:
    """All 64-bit numbers with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(64), r)], np.uint64)


def link(fps: DataFrame, distance: int = 4, dense: int = DENSE) -> DataFrame:
    """``u, v``: links between distinct fingerprints (column ``fp``) that have the same components as all pairs within ``distance``."""
    if distance != 4:
        raise ValueError("the sets of byte positions are those for a distance of 4")
    spark = fps.sparkSession
    n = fps.count()
    sets = position_sets(n > WIDE_FROM)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(f), 4096):
                part = f[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(posting_keys(part, sets).ravel()), pa.array(np.repeat(part, len(sets)))], ["key", "fp"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links; of a dense list, which goes by as it comes, each fingerprint with itself."""
        held_key, held, flooded = None, np.zeros(0, np.int64), False
        for b in batches:
            key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(key):
                continue
            key, fp = np.concatenate([np.full(len(held), held_key or 0, np.int64), key]), np.concatenate([held, fp])
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            us, vs = [], []
            if flooded and key[0] == held_key:
                us, vs = [fp[: ends[0]]], [fp[: ends[0]]]
            flood = flooded and key[0] == held_key
            for k in np.flatnonzero(ends - starts > 1).tolist():
                s, e = int(starts[k]), int(ends[k])
                if flood and not k:
                    continue
                if e - s > dense:
                    us.append(fp[s:e])
                    vs.append(fp[s:e])
                elif e < len(key):
                    part = fp[s:e]
                    got = links_in(part.view(np.uint64), distance)
                    us.append(part[[i for i, _ in got]])
                    vs.append(part[[j for _, j in got]])
            s = int(starts[-1])
            flooded = len(key) - s > dense or flood and len(starts) == 1
            held_key, held = int(key[-1]), np.zeros(0, np.int64) if flooded else fp[s:].copy()
            if us:
                yield _edges(us, vs)
        if len(held) > 1:
            got = links_in(held.view(np.uint64), distance)
            yield _edges([held[[i for i, _ in got]]], [held[[j for _, j in got]]])

    def _edges(us: list, vs: list) -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    parts = max(fps.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = fps.select("fp").mapInArrow(index, "key long, fp long").repartition(parts, "key").sortWithinPartitions("key", "fp")
    found = cut(found.mapInArrow(lists, "u long, v long"), "simhash-links")
    crowded = found.where("u = v").select(F.col("u").alias("fp")).distinct()
    points = ball(distance // 2).view(np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(f), 32):
                part = f[lo : lo + 32]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ points).ravel()), pa.array(np.repeat(part, len(points)))], ["point", "fp"])

    # At most as many fingerprints as points lie around a point, so no group is unbounded.
    around = crowded.mapInArrow(near, "point long, fp long").groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    joined = around.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).where("u != v").distinct()
    return found.where("u != v").unionByName(joined)


def linked_rows(prints: DataFrame, distance: int = 4, dense: int = DENSE) -> DataFrame:
    """``u, v``: pairs of rows (``key, fp``) that have the same components as all rows whose fingerprints are within ``distance``.

    Each fingerprint is told by its row of the smallest key. That row is paired with the fingerprint's other
    rows, with the row of the most linked fingerprint of those linked to it and with that of the most linked
    one in its component; so there are at most two pairs a row, however large a component is.
    """
    told = cut(prints.groupBy("fp").agg(F.min("key").alias("least")), "simhash-told")
    links = cut(link(told, distance, dense), "simhash-linked")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = F.struct("links", F.col("v").alias("fp"))
    linked = cut(both.groupBy("v").agg(F.count("*").alias("links")), "simhash-degrees")
    sent = F.broadcast if linked.count() <= MAX_BROADCAST else lambda df: df  # what is joined has a row for each linked fingerprint at most
    hubs = both.join(sent(linked), "v").groupBy("u").agg(F.max(degree).alias("x")).select("u", F.col("x.fp").alias("v"))
    roots = cut(components(links), "simhash-roots")
    centres = roots.join(sent(linked), F.col("node") == F.col("v")).groupBy("root").agg(F.max(degree).alias("x")).select("root", F.col("x.fp").alias("v"))
    edges = hubs.unionByName(roots.join(sent(centres), "root").select(F.col("node").alias("u"), "v"))
    between = edges.where("u <> v").distinct().join(told.toDF("u", "a"), "u").join(told.toDF("v", "b"), "v").select("a", "b")
    # A fingerprint that many rows share is one row on this side; the other is split where it is hot.
    within = prints.join(told, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    return within.unionByName(between).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, seed: int = 42, dense: int = DENSE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row; ``component_id`` is the smallest identifier reachable."""
    ship(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                f = np.array([fingerprint(t, words, seed) for t in b.column(1).slice(lo, 500).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 500), pa.array(f.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    each = cut(rows.mapInArrow(prints, "doc_id long, fp long"), "simhash-prints")
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(link(distinct, distance, dense))
    rooted = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    remove(distinct)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # A fingerprint that many rows share is one row on this side; the other is split where it is hot.
    by_print = rooted.join(named, "root").select(F.col("fp").alias("f"), "component_id")
    return each.join(by_print, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
