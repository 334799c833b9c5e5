"""Benchmark decontamination: which test items stand in which documents. DataFrame functions only.

Containment of an item in a document is the share of the item's distinct word shingles that the
document has; a pair is found at ``threshold`` (0.8) or more, over shingles of ``words`` (5) words.

Search, after containment MinHash with size partitions: items are parted by the length of their shingles
and by their number, in classes that double. An item of ``q`` shingles can lack at most
``q - ceil(threshold q)`` of them, so any one more than that has a shingle in every document that contains
the item. The sketch of an item is that many of its shingles, those with the smallest hashes. Each class is
a search of its own: a document takes part with the hashes of its shingles up to the largest of the
class's sketches, if it has as many shingles as the least item of the class needs. Of these hashes only
those that stand in a sketch leave the document's row (a set of hashes where there are at most ``MAX_SET``;
beyond, the join with the sketches sorts it out). No document with the item is missed, whatever its length.
Candidates are then verified by the exact number of shared shingles, as strings, over the whole text: only
the candidates' shingles are joined to those of items and counted for each pair, so what moves grows with
the candidates and not with the corpus.

Words are maximal runs of letters and digits after lower-casing. An item of fewer words than a shingle
has one shingle of all its words, and is looked for with shingles of that length; an item without words
is contained in nothing. Null texts count as empty. Rows that repeat an identifier are each judged by
their own text; a null identifier comes back as null. Items that repeat an identifier are separate
items with that identifier, and equal ones give one row. Empty tables give empty results; other columns
are not read, and none clashes.

Sketches, shingles of items and keys of candidates are broadcast where their number is at most
``MAX_BROADCAST`` each; beyond, the join shuffles.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, remove, text_of

MAX_BROADCAST = 200_000
MAX_SET = 50_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingles(w: Column, n: int | Column) -> Column:
    """Shingles of ``n`` words as arrays of words, in order, repeats included; none for fewer words."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n))).otherwise(F.array().cast("array<array<string>>"))


def item_sketches(items: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """``item_id, n, q, need, size_class, grams, sketch`` of every item with words."""
    w = items.select(F.col(id_col).cast("long").alias("item_id"), words_of(text_of(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.lit(words), F.size("w")))
    g = w.withColumn("grams", F.array_distinct(shingles(F.col("w"), F.col("n")))).withColumn("q", F.size("grams")).withColumn("need", F.ceil(F.col("q") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    hashed = F.array_sort(F.transform("grams", lambda x: F.xxhash64(x)))
    return g.select("item_id", "n", "q", "need", F.floor(F.log2("q")).cast("int").alias("size_class"), F.transform("grams", lambda x: F.array_join(x, " ")).alias("grams"), F.slice(hashed, F.lit(1), F.col("q") - F.col("need") + 1).alias("sketch")).distinct()


def row_key(doc_id: Column | str, text: Column | str) -> Column:
    """By what rows are told: of 10^10 rows no two have the same by chance (a probability below 2^-60)."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("second"), doc_id, text).alias("b"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment, doc_key`` of every pair found.

    ``doc_key`` is two 64-bit hashes of a row's identifier and text, by which its row can be told.
    """
    known = cut(item_sketches(items, item_id_col, item_text_col, words, threshold).withColumn("item_key", F.monotonically_increasing_id()), "bench-items")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("doc_key", row_key("doc_id", "text"))
    sketch = known.select("item_key", "n", "need", "size_class", F.explode("sketch").alias("h"))
    # A row for each length and class: a few dozen.
    classes = sketch.groupBy("n", "size_class").agg(F.max("h").alias("bound"), F.min("need").alias("need"), F.count("*").alias("rows")).collect()
    few = lambda n: n <= max_broadcast
    small = few(sum(c["rows"] for c in classes))
    listed = small and sum(c["rows"] for c in classes) <= MAX_SET
    found = None
    for n in sorted({c["n"] for c in classes}):  # at most ``words`` lengths
        own = [c for c in classes if c["n"] == n]
        w = rows.select("doc_key", words_of(F.col("text")).alias("w")).where(F.size("w") >= n + min(c["need"] for c in own) - 1)
        hashed = w.select("doc_key", (F.size("w") - (n - 1)).alias("size"), F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n))).alias("hs"))  # noqa: B023
        passes = lambda h: reduce(or_, [(h <= c["bound"]) & (F.col("size") >= c["need"]) for c in own])  # noqa: B023, E731
        kept = F.filter("hs", passes)
        if listed:
            values = ",".join(f"{r.h}L" for r in sketch.where(F.col("n") == n).select("h").distinct().orderBy("h").collect())
            kept = F.filter(F.expr(f"filter(hs, h -> h IN ({values}))"), passes)
        exploded = hashed.select("doc_key", "size", F.explode(F.array_distinct(kept)).alias("h"))
        side = sketch.where(F.col("n") == n).select(F.col("h").alias("ih"), "item_key", "need")
        hit = exploded.join(F.broadcast(side) if small else side, (F.col("h") == F.col("ih")) & (F.col("size") >= F.col("need"))).select("doc_key", "item_key")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return rows.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_shared long, containment double, doc_key struct<a:long,b:long>")
    pairs = cut(found.distinct(), "bench-candidates")
    keys = cut(pairs.select("doc_key").distinct(), "bench-keys")
    by_key = F.broadcast(keys) if few(keys.count()) else keys
    # Repeated rows have one key and one text: each key is judged once and comes back as often as it is there.
    whole = rows.join(by_key, "doc_key", "left_semi").groupBy("doc_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").cast("int").alias("times"))
    whole = cut(whole.select("doc_key", "doc_id", "times", words_of(F.col("text")).alias("w")), "bench-texts")
    shared = None
    for n in sorted({c["n"] for c in classes}):
        wanted = known.where(F.col("n") == n).select("item_key", F.explode("grams").alias("gram"))
        few_grams = few(wanted.count())
        own = known.where(F.col("n") == n).select("item_key").join(pairs, "item_key").select("doc_key").distinct()
        grams = whole.join(F.broadcast(own) if few(own.count()) else own, "doc_key", "left_semi").select("doc_key", F.explode(F.array_distinct(F.transform(shingles(F.col("w"), n), lambda x: F.array_join(x, " ")))).alias("gram"))
        each = grams.join(F.broadcast(wanted) if few_grams else wanted, "gram").groupBy("doc_key", "item_key").agg(F.count("*").alias("n_shared"))
        shared = each if shared is None else shared.unionByName(each)
    sizes = known.select("item_key", "item_id", F.col("q").cast("long").alias("n_shingles"), "need")
    good = shared.join(F.broadcast(sizes) if few(known.count()) else sizes, "item_key").where(F.col("n_shared") >= F.col("need"))
    good = good.select("doc_key", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    each = whole.select("doc_id", "doc_key", "times").join(good, "doc_key").withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
    out = cut(each.select("doc_id", "item_id", "n_shingles", "n_shared", "containment", "doc_key"), "bench-found")
    for x in (known, pairs, keys, whole):
        remove(x)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, that contain no item; only keys of those that do are sent to the rows."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    name = free_name(docs, "bad_key")
    bad = contained_items(docs, items, **options).select(F.col("doc_key").alias(name)).distinct()
    bad = F.broadcast(bad) if bad.count() <= options.get("max_broadcast", MAX_BROADCAST) else bad
    return docs.join(bad, row_key(F.col(id_col).cast("long"), text_of(text_col)) == F.col(name), "left_anti")
