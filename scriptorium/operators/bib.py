"""Bibliographies: parsing, front matter, resolution rules, serializing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import scan
from scriptorium.functions import text as T
from scriptorium.session import dealt, ship

#: Fields that are never escaped.
VERBATIM = ("doi", "url", "isbn", "issn", "zotero-key")


def entries(bibs: DataFrame, key: str = "bib_id", text: str = "text") -> DataFrame:
    """``key, no, type, entry, name, value, field_no, at``: one row per field of each entry as it stands (a row without a field for an empty entry)."""

    def rows(t: str):
        for kind, entry, fields, at in scan.bib_entries(t):
            for n, (name, value) in enumerate(fields or [(None, None)]):
                yield kind, entry, name, value, n, at

    return scan.rows_from(bibs, rows, "type string, entry string, name string, value string, field_no int, at long", key, text, "@")


def parsed(bibs: DataFrame, key: str = "bib_id", text: str = "text") -> DataFrame:
    """``key, entry, ord, type, fields`` (a map): of a repeated entry the last value, at the place of the first."""
    e = entries(bibs, key, text)
    each = e.groupBy(key, "entry", "at").agg(F.max("type").alias("type"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value"))))).alias("fields"))
    return each.groupBy(key, "entry").agg(F.min("at").alias("ord"), F.max_by("type", "at").alias("type"), F.max_by("fields", "at").alias("fields"))


def key_offsets(bibs: DataFrame, key: str = "bib_id", text: str = "text") -> DataFrame:
    """``key, entry, at``: where each entry's key first stands."""
    return entries(bibs, key, text).groupBy(key, "entry").agg(F.min("at").alias("at"))


def serialize(kind: Column, key: Column, fields: Column) -> Column:
    """One entry; ``fields`` is an array of ``struct(name, value)`` in order."""
    value = lambda f: F.when(f["name"].isin(*VERBATIM), f["value"]).otherwise(T.escape_bibtex_once(f["value"]))
    body = F.array_join(F.transform(fields, lambda f: F.concat(F.lit("  "), f["name"], F.lit(" = {"), value(f), F.lit("}"))), ",\n")
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), body, F.when(F.size(fields) > 0, "\n").otherwise(""), F.lit("}"))


def csl_item(kind: Column, fields: Column) -> Column:
    """A CSL item as JSON, from a map of fields; empty fields are left out, a year only if it is a number."""
    g = lambda n: F.nullif(F.try_element_at(fields, F.lit(n)), F.lit(""))
    names = lambda n: F.transform(T.split_authors(g(n)), T.parse_author)
    year = F.when(g("year").rlike(r"^\d+$"), F.struct(F.array(F.array(g("year").cast("long"))).alias("date-parts")))
    genre = F.when(F.lower(kind) == "mastersthesis", "Master's thesis").when(F.lower(kind) == "phdthesis", "PhD thesis")
    plain = {"volume": "volume", "pages": "page", "doi": "DOI", "publisher": "publisher", "address": "publisher-place", "url": "URL", "isbn": "ISBN", "issn": "ISSN", "number": "issue", "edition": "edition", "abstract": "abstract", "note": "note", "series": "collection-title"}
    cols = [T.csl_type(kind).alias("type"), genre.alias("genre"), g("title").alias("title"), names("author").alias("author"), year.alias("issued"), F.coalesce(g("journal"), g("booktitle")).alias("container-title"), names("editor").alias("editor")]
    return F.to_json(F.struct(*cols, *[g(a).alias(b) for a, b in plain.items()]))


#: Names of kinds of notes, with the numbers that older documents have.
NOTE_KINDS = {"in-text": "in-text", "footnotes": "footnotes", "endnotes": "endnotes", "0": "in-text", "1": "footnotes", "2": "endnotes"}
_FRONT = r"\A\s*---(?s:(.*?))\n---(?:\r?\n|\z)"


def front_matter(c: Column) -> Column:
    """``struct`` of the known keys of front matter; titles add up, the first bibliography stays, of other keys the last."""
    block = F.regexp_extract(c, _FRONT, 1)
    rows = F.transform(F.filter(F.split(block, "\n", -1), lambda x: x.contains(":")), lambda x: F.struct(T.trim_ws(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(T.trim_ws(F.substr(x, F.instr(x, ":") + 1)), "^[\"']|[\"']$", "").alias("v")))
    # The lines are bound to a variable, so that they are read once and not for each key.
    return F.get(F.transform(F.array(rows), _known_keys), F.lit(0))


def _known_keys(rows: Column) -> Column:
    of = lambda *k: F.transform(F.filter(rows, lambda r: r.k.isin(*k)), lambda r: r.v)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    full = lambda a: F.filter(a, lambda v: v != "")
    number = lambda a: last(F.filter(F.transform(a, lambda v: F.regexp_extract(v, r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")), lambda v: v > 0))
    note = F.create_map(*[F.lit(x) for kv in NOTE_KINDS.items() for x in kv])
    return F.struct(
        of("title").alias("title"),
        last(full(of("author"))).alias("author"),
        last(of("csl")).alias("csl"),
        last(of("locale")).alias("locale"),
        last(F.filter(F.transform(of("zotero-notes", "note-type"), lambda v: F.try_element_at(note, v)), lambda v: v.isNotNull())).alias("zotero_notes"),
        last(F.filter(of("notes"), lambda v: v.isin("footnotes", "endnotes"))).alias("notes"),
        last(F.filter(of("timezone"), lambda v: v.rlike(r"^[+-]\d{2}:\d{2}$"))).alias("timezone"),
        F.get(full(of("bibliography", "bib", "bibtex")), F.lit(0)).alias("bibliography"),
        last(full(of("font"))).alias("font"),
        last(full(of("code-font"))).alias("code_font"),
        number(of("font-size")).alias("font_size"),
        number(of("code-font-size")).alias("code_font_size"),
    )


def body(c: Column) -> Column:
    """The text after front matter."""
    return F.when(c.rlike(_FRONT), F.regexp_replace(F.regexp_replace(c, _FRONT, ""), r"\A\r?\n", "")).otherwise(c)


def write_front(m: Column) -> Column:
    """Front matter in its fixed order, from a struct as ``front_matter`` makes it; nothing if it has nothing."""
    # The struct is bound to a variable, so that what makes it is evaluated once and not for each key.
    return F.get(F.transform(F.array(m), _written), F.lit(0))


def _written(m: Column) -> Column:
    num = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    line = lambda k, v: F.concat(F.lit(f"{k}: "), F.nullif(v, F.lit("")))
    lines = F.concat_ws(
        "\n",
        F.transform(m.title, lambda t: F.concat(F.lit("title: "), t)),
        line("author", m.author),
        line("csl", m.csl),
        line("locale", m.locale),
        line("zotero-notes", m.zotero_notes),
        F.when(m.notes == "endnotes", "notes: endnotes"),
        line("timezone", m.timezone),
        line("bibliography", m.bibliography),
        line("font", m.font),
        line("code-font", m.code_font),
        line("font-size", num(m.font_size)),
        line("code-font-size", num(m.code_font_size)),
    )
    return F.when(lines == "", "").otherwise(F.concat(F.lit("---\n"), lines, F.lit("\n---\n")))


def bib_path(c: Column) -> Column:
    return F.when((c == "") | F.endswith(c, F.lit(".bib")), c).otherwise(F.concat(c, F.lit(".bib")))


#: Parts that the candidates of one path are dealt into.
SALTS = 1_024


def resolve_paths(candidates: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, path``: of each document the first candidate (by ``priority``) that is a file.

    Candidates of a path are dealt out by a salt, and only the different ones of each salt are looked up, so a path that all documents name, as a
    default, meets in no task: at most ``SALTS`` rows of it do.
    """
    salted = candidates.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    asked = salted.select("path", "__salt").distinct()
    there = asked.join(files.select("path").distinct(), "path").select(F.col("path").alias("__p"), F.col("__salt").alias("__s"))
    found = salted.join(there, (F.col("path") == F.col("__p")) & (F.col("__salt") == F.col("__s")))
    return found.groupBy(key).agg(F.min_by("path", "priority").alias("path"))


def definitions(citations: DataFrame, paired: DataFrame, entries_: DataFrame, key: str = "doc_id") -> DataFrame:
    """``citations`` with the entry that each key means: that of the bibliography which its document is paired with.

    ``paired`` has ``key, bib_id``; ``entries_`` has ``bib_id, entry`` and what is wanted of them.
    """
    return citations.join(paired, key).join(entries_.withColumnRenamed("entry", "key"), ["bib_id", "key"])


def usages(citations: DataFrame, paired: DataFrame, key: str = "doc_id") -> DataFrame:
    """``bib_id, key, documents, times``: of each cited key of a bibliography the documents that cite it, in order, and how often."""
    c = citations.join(paired, key).groupBy("bib_id", "key")
    return c.agg(F.sort_array(F.collect_set(key)).alias("documents"), F.count("*").alias("times"))


def affected(changed: DataFrame, paired: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that have to be looked at again when bibliographies change (``bib_id``); either may be a stream."""
    return paired.join(changed.select("bib_id").distinct() if not changed.isStreaming else changed.select("bib_id"), "bib_id").select(key).distinct()


def key_table(items: DataFrame, order: str = "ord") -> DataFrame:
    """``scope, item, key``: keys of distinct items in order of first appearance, told apart by 2, 3, ...

    ``items`` has ``scope, item, base, ord``. Keys made of two bases can only be equal if the bases are, but for
    digits at their ends. Where all items of such a stem have one base, the place of an item among them is its number, by a
    window; only stems with several bases are folded in order, row by row, so no scope is gathered.
    """
    ship(items.sparkSession)
    first = items.groupBy("scope", "item").agg(F.min_by("base", order).alias("base"), F.min(order).alias("o"))
    named = first.withColumn("stem", F.regexp_replace("base", "[0-9]+$", ""))
    mixed = named.groupBy("scope", "stem").agg(F.min("base").alias("a"), F.max("base").alias("b")).where("a <> b").select("scope", "stem")
    place = F.row_number().over(Window.partitionBy("scope", "base").orderBy("o", "item"))
    alone = named.join(mixed, ["scope", "stem"], "left_anti").withColumn("n", place)
    alone = alone.select("scope", "item", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", "n")).alias("key"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = None, scan.Distinct()
        for b in batches:
            keys = []
            for scope, stem, base in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if (scope, stem) != held:
                    held, told = (scope, stem), scan.Distinct()
                keys.append(told.of(base))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.string())], ["scope", "item", "key"])

    kinds = dict(named.dtypes)
    rows = dealt(named.join(mixed, ["scope", "stem"], "left_semi"), ["scope", "stem"], ["o", "item"])
    folded = rows.select("scope", "stem", "item", "base").mapInArrow(fold, f"scope {kinds['scope']}, item {kinds['item']}, key string")
    return alone.unionByName(folded)


def renumber(marks: DataFrame, reserved: list[int] | None = None) -> DataFrame:
    """``doc_id, name, number``: names numbered by first appearance; whole numbers that are names already stay with them."""
    first = marks.groupBy("doc_id", "name").agg(F.min("pos").alias("pos"))
    own = first.withColumn("own", F.when(F.col("name").rlike(r"^[1-9]\d*$"), F.col("name").cast("long")))
    w = Window.partitionBy("doc_id").orderBy("pos", "name")
    free = own.where("own IS NULL").withColumn("n", F.row_number().over(w))
    taken = own.where("own IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set("own")).alias("taken"))
    # The n-th free number is n, moved up by one for each taken number at or below where it comes to stand.
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<long>")), F.col("n").cast("long"), lambda a, t: a + F.when(t <= a, 1).otherwise(0))
    return free.join(taken, "doc_id", "left").select("doc_id", "name", number.alias("number")).unionByName(own.where("own IS NOT NULL").select("doc_id", "name", F.col("own").alias("number")))


def islands(rows: DataFrame, key: str, order: str, same: list[str]) -> DataFrame:
    """``rows`` with ``island``: neighbours in order with equal values in ``same`` share one."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = rows.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).otherwise(change.cast("int")))
    return marked.withColumn("island", F.sum("__new").over(w)).drop("__new")
