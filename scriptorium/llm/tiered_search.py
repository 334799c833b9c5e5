"""Ranked lexical search over a tiered index.

The index is cut by document into shards and by impact into tiers. Of each term the postings with the
highest impact, those of about a sixteenth as many documents as there are, stand in the first tier, up to
a quarter in the second, the rest in the last; where a list is cut follows from a histogram of impacts
over all documents, so that no list meets in one task. With a tier goes each term's *residual*: the
largest impact that the tiers below hold.

A search reads the first tier alone. A document's score is then at least what its postings there add up
to, and at most that and the residuals of the item's other terms. If an item's tenth best lower bound is
above the sum of all residuals, no document that the tier does not show can be among its ten best: the
documents whose upper bound reaches the tenth lower bound are scored exactly, from their rows of the
forward index, and the best are exact. Items without that proof fall through to the next tier, and at
last to all postings. No document is left out without proof, and there are no other thresholds.

Terms: maximal runs of ASCII letters, digits and any character from U+0080 on, A-Z in lower case. Of
``N`` documents with a term, ``L`` terms in all, a document's ``n`` terms, a term's ``df`` and its ``tf``
in a document: weight ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 10 + (90 n N) div L``, impact
``(10^9 tf) div (1000 tf + 8 m)``; a score is the sum of ``w`` times impact over an item's distinct terms.
All but ``w`` is integer arithmetic, and so exact: equal scores are equal, and go by ascending identifier.

Each row of the documents is a document of its own, also where identifiers repeat; a null identifier
comes last among equal scores. Rows of the items that share an identifier are one item with the terms
of all of them; a null identifier is one as well. Null texts have no terms. Items without a term, or whose
terms no document has, and empty tables give no rows. Other columns are not read. Items are searched in
blocks of at most ``MAX_ASKED`` terms or so, which bounds what is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remove, ship, text_of
from .pieces import byte_slices

MAX_ASKED = 1_000_000
MAX_TERMS = 200_000
MAX_BROADCAST = 200_000
LEAST_TIER = 2_000
TIERS = (16, 4)
BUCKETS = 64
TOP = 1_000_000
NONE, LAST = -(1 << 63), (1 << 63) - 1

_FOLD = bytes(i if i >= 128 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


@dataclass
class Index:
    """Tables of an index and the figures that scores need."""

    forward: DataFrame  # row, doc_id, n, m, terms, tfs
    postings: DataFrame  # tier, shard, term, docs, imps, ids
    terms: DataFrame  # term, df, w, r (residuals of the tiers, from the first to the last)
    n_docs: int
    n_terms: int
    tiers: int

    def remove(self) -> None:
        for df in (self.forward, self.postings, self.terms):
            remove(df)


def _counted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for b in batches:
            for lo, hi in byte_slices(b.column(2), 8_000_000):
                ns, terms, tfs, ends = [], [], [], [0]
                for text in b.column(2).slice(lo, hi - lo).to_pylist():
                    words = terms_of(text)
                    got = Counter(words if wanted is None else filter(wanted.__contains__, words))
                    ns.append(len(words))
                    terms += got
                    tfs += got.values()
                    ends.append(len(terms))
                at = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(ns, pa.int64()), *lists], ["row", "doc_id", "n", "terms", "tfs"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = sorted(set(terms_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(words), pa.int64()), pa.array(words, pa.binary()).cast(pa.string())], ["item", "term"])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, term``, distinct; a null identifier is ``NONE``."""
    ship(items.sparkSession)
    rows = items.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("item"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_item_terms, "item long, term string").distinct()


def _blocks(sent):
    """Posting lists of each batch's documents: ``tier, shard, term, docs, imps, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, whole = sent.value, (0,) * len(TIERS)
        for b in batches:
            rows = b.column(0).to_numpy()
            shards = rows >> 33
            bounds = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]) if len(rows) else []
            for lo, hi in zip(bounds, bounds[1:]):
                x = b.slice(lo, hi - lo)
                lists = x.column(3)
                flat = lists.flatten().dictionary_encode()
                if not len(flat):
                    continue
                sizes = np.diff(lists.offsets.to_numpy())
                doc = np.repeat((rows[lo:hi] & ((1 << 33) - 1)).astype(np.int32), sizes)
                ids = np.repeat(x.column(1).to_numpy(zero_copy_only=False), sizes)
                tf, m = x.column(4).flatten().to_numpy(), np.repeat(x.column(2).to_numpy(), sizes)
                imp = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                words = flat.dictionary.to_pylist()
                bucket = imp * BUCKETS // TOP
                code = flat.indices.to_numpy()
                table = np.array([cuts.get(w, whole) for w in words], np.int64)
                tier = (bucket[:, None] < table[code]).sum(1)
                order = np.lexsort((code, tier))
                key = tier[order].astype(np.int64) * len(words) + code[order]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                ends = pa.array(np.r_[starts, len(key)].astype(np.int32))
                first = order[starts]
                cols = [pa.array(tier[first].astype(np.int32)), pa.array(np.full(len(starts), shards[lo], np.int64)), flat.dictionary.take(pa.array(code[first]))]
                cols += [pa.ListArray.from_arrays(ends, pa.array(v[order], t)) for v, t in ((doc, pa.int32()), (imp, pa.int64()), (ids, pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["tier", "shard", "term", "docs", "imps", "ids"])

    return run


def build(docs: DataFrame, wanted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index | None:
    """The index of ``docs``, of the terms in ``wanted`` (``term``) or of all; None if no document has a term.

    ``wanted`` only keeps terms out that no search will ask for, and only if they are at most
    ``MAX_TERMS``; what is kept of a document is the same otherwise.
    """
    spark = docs.sparkSession
    ship(spark)
    asked = None
    if wanted is not None:
        some = wanted.select("term").distinct().limit(MAX_TERMS + 1).collect()
        asked = {r.term.encode() for r in some} if len(some) <= MAX_TERMS else None
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), text_of(text_col).alias("text"))
    forward = cut(rows.mapInArrow(_counted(spark.sparkContext.broadcast(asked)), "row long, doc_id long, n long, terms array<string>, tfs array<long>"), "search-forward")
    n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        remove(forward)
        return None
    ready = forward.withColumn("m", F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L"))
    sizes = [max(LEAST_TIER, n_docs // part) for part in TIERS]
    each = ready.select("m", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), F.expr("(1000000000 * x.tfs) div (1000 * x.tfs + 8 * m)").alias("imp"))
    buckets = each.groupBy("term", F.expr(f"imp * {BUCKETS} div {TOP}").alias("bucket")).agg(F.count("*").alias("k"), F.max("imp").alias("top"))
    before = F.sum("k").over(Window.partitionBy("term").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1))
    seen = buckets.withColumn("before", F.coalesce(before, F.lit(0)))
    stats = seen.groupBy("term").agg(
        F.sum("k").alias("df"),
        F.array(*[F.min(F.when(F.col("before") < s, F.col("bucket"))) for s in sizes]).alias("cuts"),
        F.array(*[F.coalesce(F.max(F.when(F.col("before") >= s, F.col("top"))), F.lit(0)) for s in sizes], F.lit(0).cast("long")).alias("r"),
    )
    stats = cut(stats.withColumn("w", F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1)))), "search-terms")
    # Lists of more than a tier's size are at most 16 times as many as a document has terms on average.
    long = {r.term: tuple(r.cuts) for r in stats.where(F.col("df") > sizes[0]).select("term", "cuts").toLocalIterator()}
    blocks = ready.select("row", "doc_id", "m", "terms", "tfs").mapInArrow(_blocks(spark.sparkContext.broadcast(long)), "tier int, shard long, term string, docs array<int>, imps array<long>, ids array<long>")
    from_path = cut(blocks, "search-postings", by="tier")
    ready._scriptorium_path = forward._scriptorium_path
    return Index(ready, from_path, stats, n_docs, n_terms, len(TIERS) + 1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]]:
    """Each shard's lists by term, from blocks that are sorted by shard."""
    shard, lists = None, {}
    for b in batches:
        docs, imps, ids = (b.column(i) for i in (2, 3, 4))
        at = docs.offsets.to_numpy()
        d, i, n = (x.values.to_numpy(zero_copy_only=False) for x in (docs, imps, ids))
        for k, (s, term) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if s != shard:
                if lists:
                    yield shard, lists
                shard, lists = s, {}
            part = slice(at[k], at[k + 1])
            lists.setdefault(term, []).append((d[part], i[part], n[part]))
    if lists:
        yield shard, lists


def _scored(sent, tier: int, top: int):
    """``item, row, doc_id, low`` of each shard: an item's best lower bounds, or all documents whose upper bound reaches ``floor``.

    ``sent`` has ``item: (floor, [(term, w, r), ...])``; with ``floor`` None the ``top`` best come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for shard, lists in _shards(batches):
            known = np.unique(np.concatenate([d for x in lists.values() for d, _, _ in x]))
            ids = np.empty(len(known), np.int64)
            placed = {}
            for term, x in lists.items():
                at = np.searchsorted(known, np.concatenate([d for d, _, _ in x]))
                ids[at] = np.concatenate([n for _, _, n in x])
                placed[term] = at, np.concatenate([i for _, i, _ in x])
            low, seen = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            out = []
            for item, (floor, terms) in asked.items():
                low[:], seen[:], rest = 0, 0, 0
                for term, w, r in terms:
                    rest += w * r[tier]
                    if term in placed:
                        at, imp = placed[term]
                        low[at] += w * imp
                        seen[at] += w * r[tier]
                if floor is None:
                    some = np.flatnonzero(low > 0)
                    if len(some) > top:
                        least = np.partition(low[some], -top)[-top]
                        some = some[low[some] >= least]
                        some = some[np.lexsort((known[some], ids[some], -low[some]))[:top]]
                else:
                    some = np.flatnonzero((low > 0) & (low + (rest - seen) >= floor))
                if len(some):
                    out.append((np.full(len(some), item, np.int64), (shard << 33) | known[some].astype(np.int64), ids[some], low[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["item", "row", "doc_id", "low"])

    return run


def _best(scores: DataFrame, top: int) -> DataFrame:
    """``item, rank, row, doc_id, score``: the ``top`` rows of each item."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block(index: Index, rows: list, top: int) -> list[DataFrame]:
    """The best documents of the items in ``rows`` (``item, term, w, r``), in tables."""
    spark = index.forward.sparkSession
    asked: dict[int, list] = {}
    for r in rows:
        asked.setdefault(r.item, []).append((r.term, r.w, tuple(r.r)))
    found = []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for tier in range(index.tiers):
        words = {t for terms in asked.values() for t, _, _ in terms}
        wanted = spark.createDataFrame([(t,) for t in words], "term string")
        read = index.postings.where(F.col("tier") <= tier).join(F.broadcast(wanted), "term", "left_semi")
        read = read.select("shard", "term", "docs", "imps", "ids").repartition(tasks, "shard").sortWithinPartitions("shard")

        def scored(floors: dict, tier=tier, read=read) -> DataFrame:
            sent = spark.sparkContext.broadcast(floors)
            return read.mapInArrow(_scored(sent, tier, top), "item long, row long, doc_id long, low long")

        lows = cut(_best(scored({i: (None, t) for i, t in asked.items()}).withColumnRenamed("low", "score"), top), "search-lows")
        if tier == index.tiers - 1:
            return [*found, lows]
        tenth = {r.item: r.low for r in lows.where(F.col("rank") == top).select("item", F.col("score").alias("low")).toLocalIterator()}
        rest = {i: sum(w * r[tier] for _, w, r in t) for i, t in asked.items()}
        proven = {i: t for i, t in asked.items() if rest[i] < tenth.get(i, 0) or not rest[i]}
        if proven:
            reach = cut(scored({i: (tenth.get(i, 1), t) for i, t in proven.items()}).select("item", "row"), "search-candidates")
            found.append(_exact(index, reach, [(i, t, w) for i, terms in proven.items() for t, w, _ in terms], top))
            remove(reach)
        remove(lows)
        asked = {i: t for i, t in asked.items() if i not in proven}
        if not asked:
            break
    return found


def _exact(index: Index, reach: DataFrame, weights: list, top: int) -> DataFrame:
    """The best rows of ``reach`` (``item, row``) by their whole scores, from the forward index."""
    spark = reach.sparkSession
    rows = reach.select("row").distinct()
    rows = F.broadcast(rows) if reach.count() <= MAX_BROADCAST else rows
    each = index.forward.join(rows, "row", "left_semi").select("row", "doc_id", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    imps = each.select("row", "doc_id", F.col("x.terms").alias("term"), F.expr("(1000000000 * x.tfs) div (1000 * x.tfs + 8 * m)").alias("imp"))
    w = F.broadcast(spark.createDataFrame(weights, "item long, term string, w long"))
    scores = imps.join(w, "term").join(reach, ["item", "row"], "left_semi").groupBy("item", "row", "doc_id").agg(F.sum(F.col("w") * F.col("imp")).alias("score"))
    return cut(_best(scores, top), "search-exact")


def search(index: Index, terms: DataFrame, top: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item of ``terms`` (``item, term``)."""
    spark = index.forward.sparkSession
    asked = cut(terms.join(index.terms, "term").select("item", "term", "w", "r"), "search-asked")
    blocks = max(1, math.ceil(asked.count() / MAX_ASKED))
    out = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()  # about MAX_ASKED of them
        for found in _block(index, rows, top) if rows else []:
            out = found if out is None else out.unionByName(found)
    remove(asked)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    back = lambda c, none: F.when(F.col(c) != none, F.col(c))
    return out.select(back("item", NONE).alias("item_id"), F.col("rank").cast("int").alias("rank"), back("doc_id", LAST).alias("doc_id"), "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    terms = cut(item_terms(items, item_col, item_text), "search-items")
    index = build(docs, terms, id_col, text_col)
    if index is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = search(index, terms, top)
    index.remove()
    remove(terms)
    return out
