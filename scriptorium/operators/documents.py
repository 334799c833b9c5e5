"""What resolves the parts of documents against each other, as functions of DataFrames and Columns.

Rows of a document are told apart by ``key`` and put in order by ``order``; windows are by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import ship


def adjacent(rows: DataFrame, comment: Column, target: Column, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Of each row that is a ``comment`` the place of the last ``target`` before it; other rows in between are passed over."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("target", F.last(F.when(target, F.col(order)), ignorenulls=True).over(w))
    return found.where(comment)


def by_position(left: DataFrame, right: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """``left`` with the columns of the row of ``right`` that has the same place among its document's rows."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w)
    return left.withColumn("__n", n).join(right.withColumn("__n", n).drop(order), [key, "__n"], "left").drop("__n")


def unmatched(references: DataFrame, definitions: DataFrame, on: list[str]) -> DataFrame:
    """``on, problem``: what is referred to and not defined (``undefined``), and the reverse (``unused``)."""
    r, d = (x.select(*on).distinct().withColumn(c, F.lit(True)) for x, c in ((references, "__r"), (definitions, "__d")))
    both = r.join(d, on, "full_outer")
    return both.where("__r IS NULL OR __d IS NULL").select(*on, F.when(F.col("__d").isNull(), "undefined").otherwise("unused").alias("problem"))


def transitions(rows: DataFrame, ids: str = "ids", key: str = "doc_id", order: str = "ord") -> DataFrame:
    """``rows`` with ``opens`` and ``closes``: members of the set ``ids`` that the row before lacks, and that only it has."""
    w = Window.partitionBy(key).orderBy(order)
    was = F.coalesce(F.lag(ids).over(w), F.array().cast(rows.schema[ids].dataType))
    x = rows.withColumn("__was", was)
    return x.withColumn("opens", F.array_sort(F.array_except(ids, "__was"))).withColumn("closes", F.array_sort(F.array_except("__was", ids))).drop("__was")


def rowspans(cells: DataFrame, continues: Column, keys: list[str], row: str = "row") -> DataFrame:
    """``keys, row, rowspan``: cells that continue the one above add to its span; one without a cell above goes.

    ``keys`` name the table and the column of its grid.
    """
    w = Window.partitionBy(*keys).orderBy(row)
    x = cells.withColumn("__cell", F.sum(F.when(continues, 0).otherwise(1)).over(w)).where("__cell > 0")
    return x.groupBy(*keys, "__cell").agg(F.min(row).cast("long").alias(row), F.count("*").alias("rowspan")).drop("__cell")


def grid_width(rows: list[list[tuple[int, int]]]) -> int:
    """Columns of a table's grid, from the column and row spans of each row's cells; spans from above push cells on."""
    held: dict[int, int] = {}  # column -> rows that a cell above still covers
    width = 0
    for row in rows:
        at, new = 0, {c: n - 1 for c, n in held.items() if n > 1}
        for across, down in row:
            while held.get(at):
                at += 1
            for c in range(at, at + max(1, across)):
                if down > 1:
                    new[c] = max(new.get(c, 0), down - 1)
            at += max(1, across)
        width = max([width, at, *(c + 1 for c, n in held.items() if n)])
        held = new
    return width


def grids(cells: DataFrame, key: str = "doc_id", row: str = "row", cell: str = "cell", colspan: str = "colspan", rowspan: str = "rowspan") -> DataFrame:
    """``key, columns``: the grid's width of each table, from one row per cell."""
    ship(cells.sparkSession)
    made = cells.groupBy(key, row).agg(F.array_sort(F.collect_list(F.struct(F.col(cell).alias("c"), F.col(colspan).cast("int").alias("a"), F.col(rowspan).cast("int").alias("d")))).alias("x"))
    tables = made.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), "x"))), lambda r: r.x).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = [grid_width([[(c["a"], c["d"]) for c in r] for r in rows]) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(widths, pa.int64())], [key, "columns"])

    return tables.mapInArrow(run, f"{key} {dict(cells.dtypes)[key]}, columns long")


def list_gaps(rows: DataFrame, kind: Column, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """``rows`` with ``gap``: whether an item continues the list before it, begins one, or is text (``kind`` null)."""
    w = Window.partitionBy(key).orderBy(order)
    x = rows.withColumn("__list", kind)
    before = F.lag("__list").over(w)
    return x.withColumn("gap", F.when(F.col("__list").isNull(), "text").when(F.col("__list").eqNullSafe(before), "same list").otherwise("new list")).drop("__list")


def label_order(label: str) -> list[Column]:
    """Sort keys: labels that are numbers first, by value, then the others."""
    return [F.col(label).try_cast("long").asc_nulls_last(), F.col(label).asc()]


def locale_order(text: str, collation: str = "UNICODE") -> list[Column]:
    """Sort keys for texts in a language's order; code points settle ties."""
    return [F.collate(F.col(text), collation).asc(), F.col(text).asc()]


def suggestions(asked: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """``name, style, place``: for names that are no known style, the first ``most`` styles that contain them.

    ``asked`` has ``name``, ``known`` has ``style`` and its place ``i`` in the list. The list is a table of
    styles, a few thousand rows; names meet each of them.
    """
    missing = asked.join(known, F.col("name") == F.col("style"), "left_anti")
    w = Window.partitionBy("name").orderBy("i")
    return missing.join(known, F.contains("style", "name")).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("name", "style", "place")


def merged_map(left: Column, right: Column) -> Column:
    """Two maps as one; of a key in both the right one's value."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False))), right)


def locations(rows: DataFrame, path: str = "path", at: list[str] | None = None) -> DataFrame:
    """Distinct places; paths are compared without regard to case, ``.`` and doubled slashes."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.col(path), r"/(?:\./)+", "/"), "/{2,}", "/"))
    return rows.withColumn(path, plain).dropDuplicates([path, *(at or [])])


def joined_chunks(chunks: DataFrame, key: str, number: str = "i", chunk: str = "c") -> DataFrame:
    """``key, value``: numbered chunks of each property put together in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(number).alias("i"), F.col(chunk).alias("c"))))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x.c), "").alias("value"))


def stored_text(json: Column, name: str) -> Column:
    """A member of a stored map, if it is a string; null for what is no JSON."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def restored_names(rows: DataFrame, stored: str = "stored", key: str = "doc_id", order: str = "ord") -> DataFrame:
    """``rows`` with ``id``: the stored name where it is the document's first of that name, else the next number that is no stored name."""
    first = F.row_number().over(Window.partitionBy(key, stored).orderBy(order))
    x = rows.withColumn("__own", F.col(stored).isNotNull() & (first == 1))
    doc, so_far = Window.partitionBy(key), Window.partitionBy(key, "__own").orderBy(order)
    taken = F.array_sort(F.transform(F.filter(F.collect_set(stored).over(doc), lambda s: s.rlike(r"^[1-9]\d{0,8}$")), lambda s: s.cast("long")))
    x = x.withColumn("__taken", taken).withColumn("__n", F.row_number().over(so_far).cast("long"))
    number = F.aggregate("__taken", F.col("__n"), lambda a, t: a + F.when(t <= a, 1).otherwise(0).cast("long"))
    return x.withColumn("id", F.when(F.col("__own"), F.col(stored)).otherwise(number.cast("string"))).drop("__own", "__taken", "__n")


def diagnostics(sources: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """``key`` and a count for each source's code, of documents that any source has rows of."""
    parts = [df.select(key, F.lit(code).alias("code")) for code, df in sources.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(*[F.count_if(F.col("code") == code).alias(code) for code in sources])


#: What a style's name and a locale's tag may look like, and languages whose words are counted.
STYLE_NAME, LOCALE_TAG = r"^[A-Za-z0-9][A-Za-z0-9._-]*$", r"^[a-z]{2,3}(?:-[A-Z]{2})?$"
TEXT_LANGUAGES = ("markdown", "plaintext")


def item_key(uri: Column) -> Column:
    """The eight characters by which a reference manager knows an item; null if the address has none."""
    return F.nullif(F.regexp_extract(uri, "/items/([A-Z0-9]{8})$", 1), F.lit(""))


def style_name(identifier: Column) -> Column:
    """A style's short name from its address."""
    return F.regexp_replace(identifier, "^https?://www\\.zotero\\.org/styles/", "")


def style_address(name: Column) -> Column:
    return F.when(name.contains("://"), name).otherwise(F.concat(F.lit("http://www.zotero.org/styles/"), name))


def style_field(text: Column, name: str = "csl") -> Column:
    """``struct(value, start, end)`` of the first line ``name:`` in front matter, quotes left out; null without one."""
    head = F.regexp_extract(text, r"\A---\n(?s:(.*?))\n---", 1)
    before = F.regexp_extract(head, rf"(?s)\A((?:.*?\n)??{name}:[ \t]*[\"']?)", 1)
    value = F.regexp_extract(F.substr(head, F.length(before) + 1), "^([^\"'\n]*)", 1)
    start = (F.length(before) + 4).cast("long")
    return F.when(before != "", F.struct(value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end")))


def typed(changes: Column) -> Column:
    """Whether all changes (structs of ``text`` and ``removed``) are typed: one character put in or taken out each; not without any."""
    return (F.size(changes) > 0) & F.forall(changes, lambda c: F.length(c["text"]) + c["removed"] == 1)
