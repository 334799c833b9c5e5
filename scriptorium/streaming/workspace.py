"""Diagnostics of a workspace, kept up to date by what changes.

``Workspace.apply`` takes the changes of one micro-batch (``sources.watched``) and looks again only at
the documents that they concern: those that changed, and those for which a bibliography that came, changed
or went is a candidate, whether or not they had one before. Everything it knows is in tables in one
folder, where each batch adds a part of its own (``batch=n``) to each table:

====================  ==========================================================
documents             ``path, live``
candidates            ``path, bib, priority``: where a document's bibliography may be
citations             ``path, key, start, end``
bibliographies        ``bib, live``
entries               ``bib, key``
checked               ``path, bib``: what was looked at, and by which bibliography
diagnostics           ``path, key, start, end, code, message``
====================  ==========================================================

The newest part that names a document or bibliography holds all that is true of it. A batch reads only
parts of batches before it and overwrites its own, so a batch that is replayed after a failure gives the same
tables again. Every ``compact`` batches what is true is written as a new base, which replaces the parts
before; the base before it stays, so that the last batch can still be replayed. Joins are by path and
key; no document's text is kept, and only keys and places are read again. The changes of a batch are in a table of
their own while it is worked on.

A text is one value, which a task must be able to hold. A bibliography that is too large for that comes in pieces, cut
between entries: rows of the same path that differ in ``piece``, best of some kilobytes each, as texts are read by the
thousand.

A document's candidates, in order: the bibliography that its front matter names, beside it and then at
each root (one that starts with ``/``: at the roots, then as it is), then the file of its own name. The
first that is there counts. A document without one has no diagnostics, nor has one that went.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import scan
from scriptorium.operators import bib as B
from scriptorium.session import ship

TABLES = {
    "documents": "path string, live boolean",
    "candidates": "path string, bib string, priority int",
    "citations": "path string, key string, start long, end long",
    "bibliographies": "bib string, live boolean",
    "entries": "bib string, key string",
    "checked": "path string, bib string",
    "diagnostics": "path string, key string, start long, end long, code string, message string",
}
#: The table whose newest row says which part of the others holds a document or bibliography.
_HEADS = {"documents": ("documents", "path"), "candidates": ("documents", "path"), "citations": ("documents", "path"), "bibliographies": ("bibliographies", "bib"), "entries": ("bibliographies", "bib"), "checked": ("checked", "path"), "diagnostics": ("checked", "path")}


def candidates(path: Column, named: Column, roots: list[str]) -> Column:
    """The places, in order, where a document's bibliography may be."""
    base = F.regexp_replace(path, r"(?i)\.md$", "")
    folder = F.regexp_replace(path, "/[^/]*$", "")
    file = B.bib_path(named)
    at_roots = lambda rel: [F.concat(F.lit(r.rstrip("/") + "/"), rel) for r in roots]
    absolute = F.array(*at_roots(F.substr(file, F.lit(2))), file)
    beside = F.array(F.concat(folder, F.lit("/"), file), *at_roots(file))
    own = F.array(F.concat(base, F.lit(".bib")))
    return F.array_distinct(F.when(F.coalesce(named, F.lit("")) == "", own).when(F.startswith(file, F.lit("/")), F.concat(absolute, own)).otherwise(F.concat(beside, own)))


class Workspace:
    """The tables of a workspace in ``folder`` (shared by all executors)."""

    def __init__(self, spark: SparkSession, folder: str, roots: list[str] | None = None, compact: int = 20) -> None:
        self.spark, self.folder, self.roots, self.every = spark, folder.rstrip("/"), roots or [], compact
        ship(spark)

    # Files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        system, p = self._fs(path)
        system.delete(p, True)

    def _numbers(self, folder: str, prefix: str, whole: bool) -> list[int]:
        """Numbers in the names of a folder's folders, of those that were written to the end."""
        system, p = self._fs(folder)
        if not system.exists(p):
            return []
        names = [f.getPath().getName() for f in system.listStatus(p)]
        found = sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())
        ready = lambda n: (lambda s, q: s.exists(q))(*self._fs(f"{folder}/{prefix}{n}/diagnostics/_SUCCESS"))
        return [n for n in found if not whole or ready(n)]

    def _base(self, before: int) -> int | None:
        return max((n for n in self._numbers(self.folder, "base=", True) if n < before), default=None)

    def _parts(self, table: str, before: int, base_before: int | None = None) -> DataFrame:
        """All rows of a table from batches before ``before``, with their ``batch``, from the newest base (before ``base_before``)."""
        schema = TABLES[table]
        base = self._base(before if base_before is None else base_before)
        out = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(-1).cast("long"))
        if base is not None:
            out = self.spark.read.schema(schema).parquet(f"{self.folder}/base={base}/{table}").withColumn("batch", F.lit(base).cast("long"))
        for n in self._numbers(f"{self.folder}/parts", "batch=", True):
            if n < before and (base is None or n > base):
                part = self.spark.read.schema(schema).parquet(f"{self.folder}/parts/batch={n}/{table}")
                out = out.unionByName(part.withColumn("batch", F.lit(n).cast("long")))
        return out

    def state(self, table: str, before: int = 1 << 62, base_before: int | None = None) -> DataFrame:
        """What is true of each document or bibliography before a batch."""
        head, key = _HEADS[table]
        newest = self._parts(head, before, base_before).groupBy(F.col(key).alias("__k")).agg(F.max("batch").alias("__b"))
        rows = self._parts(table, before, base_before)
        return rows.join(newest, (F.col(key) == F.col("__k")) & (F.col("batch") == F.col("__b"))).drop("__k", "__b", "batch")

    def diagnostics(self) -> DataFrame:
        return self.state("diagnostics")

    # Batches

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Take ``path, change, text``, and ``piece`` if there is one, of one batch; of a file (or piece) that is named more than once any one row should be right."""
        try:
            self._write(changes, batch)
        finally:
            self._delete(f"{self.folder}/parts/batch={batch}/changes")
        if self.every and (batch + 1) % self.every == 0:
            self._compact(batch)

    def _put(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.folder}/parts/batch={batch}/{table}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def _write(self, changes: DataFrame, batch: int) -> None:
        is_doc, is_bib = (F.lower("path").endswith(e) for e in (".md", ".bib"))
        piece = F.when(is_bib, F.col("piece").cast("string")) if "piece" in changes.columns else F.lit(None).cast("string")
        given = changes.where(is_doc | is_bib).select("path", "change", "text", piece.alias("piece"))
        last = given.groupBy("path", "piece").agg(F.max_by(F.struct("change", "text"), F.col("change") != "deleted").alias("x")).select("path", (F.col("x.change") != "deleted").alias("live"), F.coalesce("x.text", F.lit("")).alias("text"))
        # Written once and not cached: a cache is built of whole columns in memory.
        path = f"{self.folder}/parts/batch={batch}/changes"
        last.write.mode("overwrite").parquet(path)
        last = self.spark.read.schema("path string, live boolean, text string").parquet(path)
        docs, bibs = last.where(is_doc), last.where(is_bib)
        live = docs.where("live")
        new = {"documents": self._put(docs.select("path", "live"), "documents", batch)}
        named = live.select("path", B.front_matter(F.col("text")).bibliography.alias("named"))
        new["candidates"] = self._put(named.select("path", F.posexplode(candidates(F.col("path"), F.col("named"), self.roots)).alias("priority", "bib")).select("path", "bib", "priority"), "candidates", batch)
        cited = scan.rows_from(live, _cited, "key string, start long, end long", key="path", only_if="@").drop("no")
        new["citations"] = self._put(cited, "citations", batch)
        new["bibliographies"] = self._put(bibs.groupBy(F.col("path").alias("bib")).agg(F.max("live").alias("live")), "bibliographies", batch)
        entries = scan.rows_from(bibs.where("live").withColumnRenamed("path", "bib"), _keys, "key string", key="bib", only_if="@").select("bib", "key").distinct()
        new["entries"] = self._put(entries, "entries", batch)

        def now(table: str) -> DataFrame:
            head, key = _HEADS[table]
            old = self.state(table, batch)
            return old.join(new[head].select(key), key, "left_anti").unionByName(new[table])

        concerned = new["documents"].select("path").unionByName(now("candidates").join(new["bibliographies"].select("bib"), "bib", "left_semi").select("path")).distinct()
        places = now("candidates").join(concerned, "path", "left_semi").join(now("bibliographies").where("live").select("bib"), "bib", "left_semi")
        paired = concerned.join(places.groupBy("path").agg(F.min_by("bib", "priority").alias("bib")), "path", "left")
        checked = self._put(paired.select("path", "bib"), "checked", batch)
        keys = now("citations").join(checked.where("bib IS NOT NULL"), "path")
        missing = keys.join(now("entries"), ["bib", "key"], "left_anti")
        message = F.concat(F.lit("no entry has the key "), F.col("key"))
        self._put(missing.select("path", "key", "start", "end", F.lit("missing-key").alias("code"), message.alias("message")), "diagnostics", batch)

    def _compact(self, batch: int) -> None:
        """What is true after a batch as a base; bases and parts before the last base go."""
        self._delete(f"{self.folder}/base={batch}")  # of a batch that is replayed
        for table in [*(t for t in TABLES if t != "diagnostics"), "diagnostics"]:  # that it is there says that the base is whole
            now = self.state(table, batch + 1, batch)
            gone = {"documents": "live", "bibliographies": "live"}.get(table)
            (now.where(gone) if gone else now).write.mode("overwrite").parquet(f"{self.folder}/base={batch}/{table}")
        kept = self._base(batch)
        for n in self._numbers(f"{self.folder}/parts", "batch=", False) if kept is not None else []:
            if n <= kept:
                self._delete(f"{self.folder}/parts/batch={n}")
        for n in self._numbers(self.folder, "base=", False):
            if kept is not None and n < kept:
                self._delete(f"{self.folder}/base={n}")

    def follow(self, changes: DataFrame, checkpoint: str, **trigger):
        """A running query that applies a stream of changes."""
        return changes.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()


def _cited(text: str) -> list[tuple[str, int, int]]:
    """Keys that a text cites outside code, and where."""
    text = scan.blank_regions(text, scan.code_regions(text))
    return [(key, at, at + len(key)) for _, key, at in scan.citation_keys(text)]


def _keys(text: str) -> Iterator[tuple[str]]:
    """Keys of a bibliography's entries."""
    return ((key,) for _, key, _, _ in scan.bib_entries(text))
