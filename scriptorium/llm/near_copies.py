"""Near copies: rows linked through texts whose word shingles have a Jaccard similarity of ``threshold`` (0.8) or more.

The first links are those of ``simhash``: fingerprints of the same shingles, looked up through the index of byte positions,
are linked where they differ in at most 4 bits, and links of rows that are similar enough make groups.

Many pairs from 0.8 on differ in more bits, and none of them is missed. They come from an exact prefix filter: with the shingles of all texts in one
order, two texts of ``n`` and ``m`` shingles that are similar enough share one among the first
``n - ceil(threshold n) + 1`` of the one and the like of the other. Frequent shingles, found in a bounded
sample, are last in the order, so a line that many texts have is seldom in a prefix; any order is
right, only the cost depends on it. Pairs whose lengths or places cannot reach the threshold are left
out, as are those whose preceding shingle is shared as well, as that shingle's list has them. All others are verified over the
whole sets of 64-bit shingle hashes, as the links of fingerprints are.

Only rows of different groups are paired. First some rows of each list (one of every ``CENTRES`` rows, ``CENTRES`` of them at most; those with most links first; for this a part of the lists serves) are paired with the others (stars) and what
verifies makes larger groups. Stars are tried again, now from the rows that are linked most, which are those nearest to what a large
group has in common. At last all pairs of rows of different groups are tried. Rows of one
group need no more pairs, so a large group of near copies mostly costs its stars.

Around a large group there are many rows that are almost similar enough to it and to each other, and they share most of what
is in a prefix. Such rows are told by their *differences* from one row, the centre: with ``m`` and ``k`` differences and ``o`` of
them in common, two rows differ in ``m + k - 2 o`` shingles. All rows near enough to the centre are linked to it, so of a
pair that is still to be found one row is not, and the two must share more than about half the differences of the other. A
prefix filter over these, less those that no other row around the centre has, finds the pairs; changes of a row's own are
shared with none, so rows that were changed independently make no pairs. Rows of different centres are paired by their lists.

No list meets in one task: one of over ``chunk`` rows is dealt into parts of about that many. Each part has
a star, and the least rows of a list's parts have stars of their own, level by level. For the second step
rows of the group that most of such a list belong to stay in their parts, and the others go to all parts.

Words, short texts and null texts are as in ``simhash``; texts without words are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collected, cut, free_name, released, remove, ship, swept, text_of, written
from .components import components
from .simhash import linked_rows, majority, shingles

SAMPLE = 100_000
MAX_FREQUENT = 400_000
MAX_BROADCAST = 200_000
BITS, FOLD = 4096, 256
CHUNK = 20_000
CENTRES = 16
STARRED = 4


def shingle_hashes(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted, int64."""
    return _distinct(shingles(text, words, seed), seed)


def _distinct(h: np.ndarray, seed: int) -> np.ndarray:
    """Distinct hashes, sorted, int64; a text without words has one shingle, the empty one."""
    return np.unique((h if len(h) else np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)).view(np.int64))


def need(a, b, threshold: float):
    """Shingles that sets of ``a`` and ``b`` must share."""
    return np.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of a row's identifier and text. By it and ``second_key`` together its row can be told."""
    return F.xxhash64(F.col(id_col).cast("long"), text_of(text_col))


def second_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Another hash of the same, begun from another seed."""
    return F.xxhash64(F.lit("second"), F.col(id_col).cast("long"), text_of(text_col))


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (``key, second`` and others) where rows of one ``key`` but different ``second`` get keys of their own."""
    shared = cut(rows.groupBy("key").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a <> b").select("key", F.lit(True).alias("shared")), "near-shared")
    n = shared.count()
    if not n:
        return rows
    both = rows.join(F.broadcast(shared) if n <= MAX_BROADCAST else shared, "key", "left")
    return both.withColumn("key", F.when(F.col("shared"), F.xxhash64("key", "second")).otherwise(F.col("key"))).drop("shared")


def _frequent(rows: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and their numbers, from a bounded sample."""
    n = rows.count()
    part = rows.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_hashes(t, words, seed) for t in b.column(0).slice(lo, 200).to_pylist()]))], ["h"])

    got = part.mapInArrow(released(run), "h long").groupBy("h").count().where("count >= 2").orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).toArrow()
    h, c = (got.column(i).to_numpy() for i in (0, 1))
    at = np.argsort(h)
    return h[at], c[at]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each run of equal values of the first column, where it has two rows or more."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        if held and cols[0][0] != held[0][0][0]:
            if sum(len(x[0]) for x in held) > 1:
                yield [np.concatenate(x) for x in zip(*held)]
            held = []
        if not len(cuts):
            held.append([c.copy() for c in cols])
            continue
        bounds = np.r_[0, cuts, len(cols[0])]
        first = [c[: cuts[0]] for c in cols]
        whole = [np.concatenate(x) for x in zip(*held, first)]
        if len(whole[0]) > 1:
            yield whole
        for k in np.flatnonzero(np.diff(bounds)[1:-1] > 1) + 1:
            yield [c[bounds[k] : bounds[k + 1]] for c in cols]
        held = [[c[cuts[-1] :].copy() for c in cols]]
    if held and sum(len(x[0]) for x in held) > 1:
        yield [np.concatenate(x) for x in zip(*held)]


def _may(i: int, j: np.ndarray, n: np.ndarray, pos: np.ndarray, prev: np.ndarray, fold: np.ndarray, threshold: float) -> np.ndarray:
    """Those of ``j`` that can be similar to ``i``: by the lengths, by what may follow the shared shingle, and by parities."""
    rest = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 + np.minimum(pos[i], pos[j])
    ok = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & (rest >= need(n[i], n[j], threshold))
    j = j[ok & ((pos[i] == 0) | (pos[j] == 0) | (prev[i] != prev[j]))]
    return j[np.bitwise_count(fold[i] ^ fold[j]).sum(1, dtype=np.int64) <= n[i] + n[j] - 2 * need(n[i], n[j], threshold)]


def _pairs(star: bool, threshold: float):
    """Pairs of each list's rows of different roots, from ``h, key, n, pos, prev, root, linked, own, fold, centre``: those of its most linked rows, or all of different centres.

    Of a pair one row at least is the list's ``own``; others are there to meet those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0
        for _, key, n, pos, prev, root, linked, own, fold, centre in _lists(batches):
            fold = np.frombuffer(b"".join(fold), np.uint64).reshape(len(key), -1)
            if star:
                order = np.lexsort((key, -linked))
                todo = order[: min(CENTRES, -(-len(key) // CENTRES))].tolist()
                rank = np.argsort(order)
            else:
                # Each pair of different groups has a row outside the largest group, and likewise with centres.
                sides = [(count.max(), inverse == np.argmax(count)) for _, inverse, count in (np.unique(x, return_inverse=True, return_counts=True) for x in (root, centre))]
                most, inside = max(sides, key=lambda x: x[0])
                if most == len(key):
                    continue
                rank = np.where(inside, len(key), np.arange(len(key)))
                todo = np.flatnonzero(~inside).tolist()
            for i in todo:
                j = np.flatnonzero((root != root[i]) & (centre != centre[i]) & (rank > rank[i]) & (own | own[i]))
                j = _may(i, j, n, pos, prev, fold, threshold)
                if len(j):
                    us.append(np.minimum(key[i], key[j]))
                    vs.append(np.maximum(key[i], key[j]))
                    held += len(j)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                    us, vs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _by_list(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "h").sortWithinPartitions("h")


def _part(salt: Column) -> Column:
    """The name of a list's part."""
    return F.xxhash64("h", salt)


def _dealt(lists: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """The lists in parts (column ``list``: the list that a part is of), and ``list, salts`` of those that have several."""
    hot = cut(lists.groupBy("h").count().where(F.col("count") > chunk).select(F.col("h").alias("list"), F.ceil(F.col("count") / chunk).cast("long").alias("salts")), "near-hot")
    n = hot.count()
    if not n:
        return lists.withColumn("list", F.col("h")), None
    x = lists.withColumn("list", F.col("h")).join(F.broadcast(hot) if n <= MAX_BROADCAST else hot, "list", "left")
    part = F.when(F.col("salts").isNull(), F.col("h")).otherwise(_part(F.pmod(F.xxhash64("key", "h"), "salts")))
    return x.withColumn("h", part).drop("salts"), hot


def _stars(lists: DataFrame, parts: int, threshold: float, chunk: int) -> DataFrame:
    """``u, v``: of each list the pairs of its most linked rows with those of other roots; of parts, and of the first rows of a list's parts."""
    found = None
    while True:
        dealt, hot = _dealt(lists, chunk)
        rows = dealt.select("h", "key", "n", "pos", "prev", "root", "linked", F.lit(True).alias("own"), "fold", F.col("key").alias("centre"))
        pairs = _by_list(rows, parts).mapInArrow(released(_pairs(True, threshold)), "u long, v long").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        if hot is None:
            return found.distinct()
        small = F.broadcast(hot) if hot.count() <= MAX_BROADCAST else hot
        first = dealt.join(small.select("list"), "list", "left_semi").groupBy("list", "h").agg(F.min(F.struct((-F.col("linked")).alias("least"), "key", "n", "pos", "prev", "root", "fold")).alias("x"))
        lists = cut(first.select(F.col("list").alias("h"), "x.key", "x.n", "x.pos", "x.prev", "x.root", (-F.col("x.least")).alias("linked"), "x.fold"), "near-firsts")


def _apart(docs: DataFrame, named: DataFrame, parts: int, words: int, threshold: float, seed: int, chunk: int) -> DataFrame:
    """``u, v``: the pairs of each list's rows of different roots; of rows around one centre those that their differences leave."""
    named = cut(named, "near-last")
    far = _differences(docs, named, words, threshold, seed)
    centres = far.select("key", "centre")
    centres = F.broadcast(centres) if far.count() <= MAX_BROADCAST else centres
    named = named.join(centres, "key", "left").withColumn("centre", F.coalesce("centre", "key"))
    dealt, hot = _dealt(named, chunk)
    rows = dealt.withColumn("own", F.lit(True))
    if hot is not None:
        small = F.broadcast(hot) if hot.count() <= MAX_BROADCAST else hot
        ofhot = named.withColumnRenamed("h", "list").join(small, "list")
        root, centre = (ofhot.groupBy("list", c).count().groupBy("list").agg(F.max_by(c, "count").alias(f"most_{c}"), F.max("count").alias(f"rows_{c}")) for c in ("root", "centre"))
        most = cut(root.join(centre, "list"), "near-most")
        outside = F.when(F.col("rows_centre") > F.col("rows_root"), F.col("centre") != F.col("most_centre")).otherwise(F.col("root") != F.col("most_root"))
        few = ofhot.join(F.broadcast(most) if most.count() <= MAX_BROADCAST else most, "list").where(outside)
        home = F.pmod(F.xxhash64("key", F.col("list")), "salts")
        sent = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).where(F.col("salt") != home)
        sent = sent.select(F.xxhash64("list", "salt").alias("h"), "key", "n", "pos", "prev", "root", "linked", F.lit(False).alias("own"), "fold", "centre")
        rows = rows.select(*sent.columns).unionByName(sent)
    plain = _by_list(rows.select("h", "key", "n", "pos", "prev", "root", "linked", "own", "fold", "centre"), parts).mapInArrow(released(_pairs(False, threshold)), "u long, v long")
    return plain.unionByName(_around(far, parts, threshold)).distinct()


def _differences(docs: DataFrame, named: DataFrame, words: int, threshold: float, seed: int) -> DataFrame:
    """``centre, key, root, n, nc, d, near`` of rows around a centre: ``d`` is what the shingles of row and centre do not share.

    A row goes to the most linked row of most of its lists. Of the rows that went there, that which is nearest to what
    over half of them hold becomes the centre of all. ``near`` tells whether a row is similar to it.
    """
    best = named.groupBy("h").agg(F.count("*").alias("rows"), F.min("root").alias("a"), F.max("root").alias("b"), F.max(F.struct("linked", "key")).alias("best")).where("a <> b AND rows > 2")
    votes = named.select("h", "key", "root").join(best.select("h", F.col("best.key").alias("first")), "h").groupBy("key", "root", "first").count()
    chosen = cut(votes.groupBy("key", "root").agg(F.max(F.struct("count", "first")).alias("x")).where("x.count > 1").select("key", "root", F.col("x.first").alias("first")), "near-chosen")
    mixed = chosen.groupBy("first").agg(F.count("*").alias("rows"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b AND rows > 2").select("first")
    chosen = cut(chosen.join(mixed, "first", "left_semi"), "near-members")
    own = _sets(docs, chosen.select("key").unionByName(chosen.select(F.col("first").alias("key"))).distinct(), words, seed)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                x, y = ([np.frombuffer(z.as_buffer(), np.int64) for z in part.column(i)] for i in (3, 4))
                d = [np.setxor1d(p, q, assume_unique=True) for p, q in zip(x, y)]
                ok = [2 * len(z) <= len(p) + len(q) for z, p, q in zip(d, x, y)]
                ends = np.concatenate([[0], np.cumsum([len(z) for z in d])]).astype(np.int32)
                out = [part.column(0), part.column(1), part.column(2), pa.array([len(p) for p in x], pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(d))]
                yield pa.RecordBatch.from_arrays(out, ["first", "key", "root", "n", "d"]).filter(pa.array(ok, pa.bool_()))

    both = chosen.join(own.withColumnRenamed("x", "a"), "key").join(own.select(F.col("key").alias("first"), F.col("x").alias("b")), "first")
    told = cut(both.select("first", "key", "root", "a", "b").mapInArrow(released(differ), "first long, key long, root long, n long, d array<long>"), "near-differences")
    remove(own)
    rows = told.groupBy("first").agg(F.count("*").alias("rows"))
    often = told.select("first", F.explode("d").alias("e")).groupBy("first", "e").count().join(rows, "first").where("2 * count > rows").groupBy("first").agg(F.collect_list("e").alias("held"))
    distance = F.size("d") + F.coalesce(F.size("held"), F.lit(0)) - 2 * F.coalesce(F.size(F.array_intersect("d", "held")), F.lit(0))
    least = F.min_by(F.struct(F.col("key").alias("centre"), F.col("n").alias("nc"), F.col("d").alias("dc")), F.struct("distance", "key"))
    centres = told.join(often, "first", "left").withColumn("distance", distance).groupBy("first").agg(least.alias("c")).select("first", "c.*")
    d = F.array_union(F.array_except("d", "dc"), F.array_except("dc", "d"))
    far = told.join(centres, "first").select("centre", "key", "root", "n", "nc", d.alias("d"))
    needed = F.ceil((F.col("n") + F.col("nc")) * (threshold / (1 + threshold)) - 1e-9)
    return cut(far.withColumn("near", F.size("d") <= F.col("n") + F.col("nc") - 2 * needed), "near-far")


def _around(far: DataFrame, parts: int, threshold: float) -> DataFrame:
    """``u, v``: pairs of a centre and what is near it, and those of rows around a centre, not both near it, whose differences may make them similar.

    Two sets of ``n`` and ``n'`` are similar if they differ in ``r (n + n')`` at most. A row that is not near differs from the centre
    in more than ``r (n + nc)``; so with it a row of ``m`` differences shares ``(m + r (nc - n)) / 2`` of them or more, and it shares
    ``(m - r (n + nc)) / 2`` of its own or more with any.
    """
    r = (1 - threshold) / (1 + threshold)
    held = far.select("centre", "key", F.explode("d").alias("e"))
    times = held.groupBy("centre", "e").count().where("count > 1")
    shared = held.join(times, ["centre", "e"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("count", "e"))).alias("es"))
    rows = far.join(shared, "key").withColumn("m", F.size("d").cast("long")).withColumn("s", F.size("es").cast("long"))
    least = lambda o: F.col("s") - F.greatest(F.lit(1), F.ceil(o / 2 - 1e-6)) + 1
    brief, whole = least(F.col("m") + r * (F.col("nc") - F.col("n"))), least(F.col("m") - r * (F.col("nc") + F.col("n")))
    rows = rows.withColumn("brief", brief).withColumn("whole", F.when(F.col("near"), F.col("brief")).otherwise(F.greatest("brief", whole)))
    rows = rows.select("centre", "key", "n", "m", "s", "root", "near", "brief", "whole", F.posexplode("es").alias("pos", "x")).where("pos < whole")
    rows = rows.select(F.xxhash64("centre", "x.e").alias("h"), "key", "n", "m", "s", F.col("pos").cast("long").alias("pos"), "root", "near", (F.col("pos") < F.col("brief")).alias("brief"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n, m, s, pos, root, near, brief in _lists(batches):
            for i in np.flatnonzero(~near).tolist():
                j = np.flatnonzero((root != root[i]) & brief & (near | (brief[i] & (np.arange(len(key)) > i))))
                bound = n[i] + n[j] - 2 * need(n[i], n[j], threshold)
                most = np.minimum(pos[i], pos[j]) + np.minimum(s[i] - pos[i], s[j] - pos[j])
                j = j[(2 * most >= m[i] + m[j] - bound) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)]
                if len(j):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], ["u", "v"])

    found = _by_list(rows, parts).mapInArrow(released(meet), "u long, v long")
    return found.unionByName(far.where("near AND key <> centre").select(F.least("key", "centre").alias("u"), F.greatest("key", "centre").alias("v")))


def similar_pairs(docs: DataFrame, words: int = 5, threshold: float = 0.8, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """``u, v``: verified pairs that link the rows of ``docs`` (``key, text``) as all similar pairs would."""
    spark, before = docs.sparkSession, written()
    ship(spark)
    sent = spark.sparkContext.broadcast(_frequent(docs, words, seed))  # at most MAX_FREQUENT pairs of numbers

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                ns, ps, fps, firsts = [], [], [], []
                for text in b.column(1).slice(lo, 500).to_pylist():
                    h = shingles(text, words, seed)
                    fps.append(majority(h))
                    h = _distinct(h, seed)
                    ns.append(len(h))
                    ps.append(parities(h))
                    if len(often):
                        at = np.searchsorted(often, h).clip(max=len(often) - 1)
                        if (met := often[at] == h).any():
                            h = h[np.lexsort((h, np.where(met, times[at], 0)))]
                    firsts.append(h[: len(h) - math.ceil(threshold * len(h) - 1e-9) + 1])
                ends = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
                folds = [np.bitwise_xor.reduce(np.frombuffer(p, np.uint64).reshape(-1, FOLD // 64)).tobytes() for p in ps]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 500), pa.array(ns, pa.int32()), pa.array(ps, pa.binary()), pa.array(folds, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.ListArray.from_arrays(ends, np.concatenate(firsts))], ["key", "n", "p", "fold", "fp", "hs"])

    # Each text is hashed once: its number of shingles, their parities, its fingerprint and the prefix.
    sketches = cut(docs.mapInArrow(released(sketch), "key long, n int, p binary, fold binary, fp long, hs array<long>"), "near-sketches")
    tried = cut(linked_rows(sketches.select("key", "fp")), "near-prints")
    found = verified(docs, sketches.select("key", "n", "p"), tried, words, threshold, seed)
    parts = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    prefixes = sketches.select("key", "n", "hs", F.posexplode("hs").alias("pos", "h")).select("h", "key", "n", "pos", F.when(F.col("pos") > 0, F.element_at("hs", F.col("pos"))).otherwise(F.lit(0).cast("long")).alias("prev"))
    lists = cut(_by_list(prefixes, parts).mapInArrow(released(_shared), "h long, key long, n int, pos int, prev long"), "near-lists")
    folds = sketches.select("key", "fold")
    folds = F.broadcast(folds) if sketches.count() <= MAX_BROADCAST else folds
    lists = lists.join(folds, "key")
    sketches = sketches.select("key", "n", "p")
    for step in range(3):
        last = step == 2
        # A pair shares many lists: for stars one list of each STARRED serves, the last step has all lists.
        named = _named(lists if last else lists.where(F.pmod(F.xxhash64("h"), F.lit(STARRED)) == step), found)
        more = _apart(docs, named, parts, words, threshold, seed, chunk) if last else _stars(named, parts, threshold, chunk)
        more = cut(more.join(tried, ["u", "v"], "left_anti"), "near-more")
        found = cut(found.unionByName(verified(docs, sketches, more, words, threshold, seed)), "near-found")
        tried = more if last else tried.unionByName(more)
    swept(before, found)
    return found


def _named(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of lists with the root of the group that each belongs to by the pairs in ``found``, and how many of those it is in."""
    roots = cut(components(found), "near-roots").withColumnRenamed("node", "key")
    linked = found.select(F.col("u").alias("key")).unionByName(found.select(F.col("v").alias("key"))).groupBy("key").agg(F.count("*").alias("linked"))
    known = cut(roots.join(linked, "key"), "near-known")
    known = F.broadcast(known) if known.count() <= MAX_BROADCAST else known
    return lists.join(known, "key", "left").select("h", "key", "n", "pos", "prev", F.coalesce("root", "key").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"), "fold")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by ``h``, whose ``h`` another row has too; what is held of a run is its first row."""
    held: pa.RecordBatch | None = None  # the last row, if it is the first of its run
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        keep = np.zeros(len(h), bool)
        keep[1:] |= h[1:] == h[:-1]
        keep[:-1] |= h[1:] == h[:-1]
        if last is not None and h[0] == last:
            keep[0] = True
            if held is not None:
                yield held
        held = None if keep[-1] else b.slice(len(h) - 1)
        last = h[-1]
        if keep.any():
            yield b.filter(pa.array(keep))


def parities(h: np.ndarray) -> bytes:
    """Whether an odd number of hashes falls on each of ``BITS`` places."""
    return np.packbits(np.bincount(h & (BITS - 1), minlength=BITS) & 1 == 1).tobytes()


def _sets(docs: DataFrame, named: DataFrame, words: int, seed: int) -> DataFrame:
    """``key, x``: the distinct hashes of the rows of ``docs`` that ``named`` has."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                x = [shingle_hashes(t, words, seed).tobytes() for t in b.column(1).slice(lo, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 200), pa.array(x, pa.binary())], ["key", "x"])

    small = named.count() <= MAX_BROADCAST
    own = docs.join(F.broadcast(named) if small else named, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(released(sets), "key long, x binary")
    return cut(own, "near-sets")


def verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, words: int, threshold: float, seed: int) -> DataFrame:
    """The pairs ``u, v`` of rows of ``docs`` whose shingles are similar.

    Places where parities differ have a shingle each that one row lacks: too many rule a pair out
    before whole sets move.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (4, 5))
            ok = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= n + m - 2 * need(n, m, threshold)
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.int64) for z in (x, y))
                at = np.searchsorted(y, x)
                both = int((y[at.clip(max=len(y) - 1)] == x).sum())
                ok.append(both >= need(len(x), len(y), threshold))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sketches.toDF("u", "n", "p"), "u").join(sketches.toDF("v", "m", "q"), "v")
    left = cut(both.select("u", "v", "n", "m", "p", "q").mapInArrow(released(sift), "u long, v long").distinct(), "near-sifted")
    named = cut(left.select(F.col("u").alias("key")).unionByName(left.select(F.col("v").alias("key"))).distinct(), "near-named")
    own = _sets(docs, named, words, seed)
    found = left.join(own.select(F.col("key").alias("u"), F.col("x").alias("a")), "u").join(own.select(F.col("key").alias("v"), F.col("x").alias("b")), "v")
    out = cut(found.select("u", "v", "a", "b").mapInArrow(released(test), "u long, v long"), "near-verified")
    remove(own)
    collected(docs.sparkSession)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """``row_key, second, kept`` of every row that has a near copy: of each linked group one row stays.

    Rows are told by two 64-bit hashes, ``row_key`` and ``second``. That is the row with the smallest identifier; a null one stays only where its group has no other.
    """
    told = row_key(id_col, text_col)
    rows = docs.select(told.alias("key"), told.alias("row_key"), second_key(id_col, text_col).alias("second"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = _told_apart(rows)
    roots = cut(components(similar_pairs(rows.select("key", "text"), words, threshold, seed, chunk)), "near-groups")
    named = cut(rows.select("key", "row_key", "second", "doc_id").join(roots, F.col("key") == F.col("node")).select("key", "row_key", "second", "doc_id", "root"), "near-named")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m")).select(F.col("root").alias("r"), F.col("m.key").alias("stays"))
    return named.join(least, F.col("root") == F.col("r")).select("row_key", "second", (F.col("key") == F.col("stays")).alias("kept")).distinct()


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns: one of each group of near copies; keys of those that go are sent to the rows."""
    name, other = free_name(docs, "key_of_row"), free_name(docs, "second_key_of_row")
    before = written()
    gone = cut(near_copies(docs, id_col, text_col, **options).where("NOT kept").select(F.col("row_key").alias(name), F.col("second").alias(other)), "near-gone")
    swept(before, gone)
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone
    return docs.join(gone, (row_key(id_col, text_col) == F.col(name)) & (second_key(id_col, text_col) == F.col(other)), "left_anti")
