"""Queries on bibliographies, front matter, threads, numbering, merging and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import bib
from scriptorium.operators import documents as D
from scriptorium.operators.threads import roots
from scriptorium.plans.planted import SEGMENTS, manuscripts, segments
from scriptorium.plans.spans import _CITES, citations
from scriptorium.session import spread, table
from scriptorium.streaming import edits

#: A bibliography per part size: one entry per part, every fifth one again with another title.
ENTRY = "concat('@article{{p', p_partkey, ',\n  author = {{', p_brand, ' and {{Sons, Inc}}}},\n  title = {{{{', p_name, {0}, '}}}},\n  journal = \"J. of ', p_type, '\",\n  year = ', 1900 + p_size, ',\n  note = {{50\\\\% off}}\n}}\n')"


def bibliographies(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    one = p.select("p_size", F.lit(0).alias("r"), "p_partkey", F.expr(ENTRY.format("''")).alias("e"))
    two = p.where("p_partkey % 5 = 0").select("p_size", F.lit(1).alias("r"), "p_partkey", F.expr(ENTRY.format("' again'")).alias("e"))
    g = one.unionByName(two).groupBy(F.col("p_size").cast("long").alias("bib_id")).agg(F.array_sort(F.collect_list(F.struct("r", "p_partkey", "e"))).alias("x"))
    return g.select("bib_id", F.array_join(F.transform("x", lambda r: r.e), "").alias("text"))


def bib_parse(spark: SparkSession, d: str) -> DataFrame:
    e = bib.entries(bibliographies(spark, d))
    return e.groupBy("bib_id", "entry").agg(F.countDistinct("at").alias("times"), F.max("type").alias("type"), F.min(F.when(F.col("name") == "author", F.col("value"))).alias("author"), F.min(F.when(F.col("name") == "note", F.col("value"))).alias("note"))


def bib_last_wins(spark: SparkSession, d: str) -> DataFrame:
    p = bib.parsed(bibliographies(spark, d))
    w = Window.partitionBy("bib_id").orderBy("ord")
    return p.select("bib_id", "entry", F.row_number().over(w).cast("long").alias("place"), F.col("fields")["title"].alias("title"), F.col("fields")["journal"].alias("journal"), F.col("fields")["year"].alias("year"))


def bib_key_offsets(spark: SparkSession, d: str) -> DataFrame:
    return bib.key_offsets(bibliographies(spark, d)).groupBy("bib_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 50 + 1).alias("bib_id"))


def citation_definitions(spark: SparkSession, d: str) -> DataFrame:
    e = bib.parsed(bibliographies(spark, d)).select("bib_id", "entry", F.col("fields")["title"].alias("title"))
    return bib.definitions(citations(manuscripts(spark, d)), _paired(spark, d), e).select("doc_id", "key", "key_start", "title")


def bibliography_usages(spark: SparkSession, d: str) -> DataFrame:
    u = bib.usages(citations(manuscripts(spark, d)), _paired(spark, d))
    return u.select("bib_id", "key", F.array_join(F.col("documents").cast("array<string>"), ",").alias("documents"), "times")


def affected_documents(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "part").where("p_partkey % 40 = 1").select(F.col("p_size").cast("long").alias("bib_id"))
    return bib.affected(changed, _paired(spark, d))


def bib_serialize(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    f = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("title", F.concat("p_name", F.lit(" & 5%"))), ("doi", F.concat(F.lit("10.1/a_"), "p_partkey")))])
    return p.select("p_partkey", bib.serialize(F.lit("article"), F.concat(F.lit("p"), "p_partkey"), f).alias("out"))


def csl_item(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    m = F.create_map(F.lit("title"), F.col("p_name"), F.lit("year"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN CAST(1900 + p_size AS STRING) ELSE 'n.d.' END"), F.lit("journal"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END"), F.lit("booktitle"), F.lit("Proc."), F.lit("author"), F.concat(F.lit("{"), "p_brand", F.lit("}")), F.lit("pages"), F.col("p_size").cast("string"))
    return p.select("p_partkey", bib.csl_item(F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'phdthesis' ELSE 'article' END"), m).alias("item"))


FRONT = """concat(CASE WHEN p_partkey % 2 = 0 THEN '\n' ELSE '' END, '---\ntitle: ', p_name, '\ntitle: "', p_type, '"\nauthor: \nauthor: ', p_brand, '\nbib: \nbibtex: refs', p_size, '\nbibliography: other\nfont-size: ', p_size, 'pt\ncode-font-size: 0\ntimezone: +02:00\ntimezone: CET\nnotes: endnotes\nnotes: x\nnote-type: 1\nunknown: 3\nno colon\n---\n\nBody')"""


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "part")).select("p_partkey", bib.front_matter(F.expr(FRONT)).alias("m"), bib.body(F.expr(FRONT)).alias("body"))
    return p.select("p_partkey", F.array_join("m.title", "|").alias("title"), "m.author", bib.bib_path(F.col("m.bibliography")).alias("bibliography"), "m.font_size", "m.code_font_size", "m.timezone", "m.notes", "m.zotero_notes", "m.csl", "body")


def front_matter_write(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part")).select("p_partkey", bib.write_front(bib.front_matter(F.expr(FRONT))).alias("out"))


def bib_path_resolution(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey"))
    c = o.select("doc_id", F.posexplode(F.array(F.concat(F.lit("own/"), "doc_id", F.lit(".bib")), F.concat(F.lit("cust/"), "o_custkey", F.lit(".bib")), F.lit("default.bib"))).alias("priority", "path"))
    files = o.where("doc_id % 3 = 0").select(F.concat(F.lit("own/"), "doc_id", F.lit(".bib")).alias("path")).unionByName(table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("cust/"), "c_custkey", F.lit(".bib")).alias("path"))).unionByName(spark.createDataFrame([("default.bib",)], "path string"))
    return bib.resolve_paths(c, files)


def citation_key_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    items = li.select(F.col("l_suppkey").alias("scope"), F.col("l_partkey").alias("item"), F.concat(F.lit("k"), F.col("l_partkey") % 3).alias("base"), F.col("l_partkey").alias("ord"))
    return bib.key_table(items).select("scope", "item", "key")


def first_appearance_renumber(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    name = F.when(F.col("a") % 4 == 0, (F.col("a") % 5 + 1).cast("string")).otherwise(F.concat(F.lit("n"), F.col("a") % 7))
    return bib.renumber(s.select("doc_id", name.alias("name"), F.col("ord").alias("pos")))


def note_orphans(spark: SparkSession, d: str) -> DataFrame:
    """References without a definition, and definitions without a reference."""
    s = segments(spark, d).select("doc_id", "kind", (F.col("a") % 6).alias("label"))
    return D.unmatched(s.where("kind < 4"), s.where("kind >= 4"), ["doc_id", "label"])


def reply_roots(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every reply: each turn answers the one before it."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    return roots(c)


def thread_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    x = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(x.alias("x")).select("conv_id", F.md5(F.array_join(F.transform("x", lambda r: F.concat(F.lit("{>>"), r.role, F.lit(": "), r.text, F.lit("<<}"))), "")).alias("hash"), F.get("x", F.lit(0)).role.alias("author"))


def run_merge(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring runs of equal format made one."""
    s = segments(spark, d).withColumn("bold", F.col("kind") % 2 == 0).withColumn("href", F.when(F.col("color") == "red", "x"))
    g = bib.islands(s, "doc_id", "ord", ["bold", "href"]).groupBy("doc_id", "island").agg(F.min("bold").alias("bold"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "a"))), lambda r: r.a.cast("string")), "").alias("text"))
    return g


def code_block_group(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("code", F.col("kind") >= 5)
    g = bib.islands(s, "doc_id", "ord", ["code"]).where("code").groupBy("doc_id", "island").agg(F.count("*").alias("lines"))
    return g.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1).cast("long").alias("block"), "lines")


def rowspans(spark: SparkSession, d: str) -> DataFrame:
    """Vertically merged cells."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).alias("col"), F.col("l_linenumber").alias("row"), "l_quantity").groupBy("doc_id", "col", "row").agg((F.max("l_quantity") % 2 == 0).alias("cont"))
    return D.rowspans(li, F.col("cont"), ["doc_id", "col"])


def comment_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Comments that open and close between neighbouring runs."""
    x = D.transitions(segments(spark, d).withColumn("ids", F.array_distinct(F.array(F.col("a") % 3, F.col("b") % 3))))
    return x.select("doc_id", "ord", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("opens", "closes")])


def list_spacing(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") < 3, "bullet").when(F.col("kind") < 5, "ordered")
    return D.list_gaps(segments(spark, d), kind).groupBy("gap").agg(F.count("*").alias("n"))


def label_sort(spark: SparkSession, d: str) -> DataFrame:
    """Labels in order: numbers first, by value, then the others."""
    p = table(spark, d, "part").select(F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('n', p_partkey) ELSE CAST(p_partkey AS STRING) END").alias("label"), "p_size")
    w = Window.partitionBy("p_size").orderBy(*D.label_order("label"))
    return p.select("p_size", "label", F.row_number().over(w).cast("long").alias("place"))


def style_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """For names that are no known style, the first three known ones that contain them, in the order of the list."""
    known = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("style"))
    asked = spark.createDataFrame([("red",), ("bolt",), ("small ring",), ("zzz",)], "name string")
    return D.suggestions(asked, known)


def key_locale_sort(spark: SparkSession, d: str) -> DataFrame:
    """Each part's key among those of its size, in the order of the language: accents and cases count last."""
    letters = F.element_at(F.array(*map(F.lit, "aAäÄbBzéeE")), (F.col("p_partkey") % 10 + 1).cast("int"))
    p = table(spark, d, "part").select("p_size", F.concat(letters, F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("key"))
    w = Window.partitionBy("p_size").orderBy(*D.locale_order("key"))
    return p.select("p_size", "key", F.row_number().over(w).cast("long").alias("place"))


def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two maps merged, the right one winning."""
    pairs = lambda n, v: F.map_from_entries(F.collect_set(F.struct((F.col("n_nationkey") % n).alias("k"), (F.col("n_nationkey") % n + v).alias("v"))))
    both = table(spark, d, "nation").groupBy("n_regionkey").agg(pairs(4, 100).alias("l"), pairs(3, 200).alias("r"))
    return both.select("n_regionkey", F.explode(D.merged_map(F.col("l"), F.col("r"))).alias("k", "v"))


def location_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat(F.expr("CASE l_linenumber % 2 WHEN 0 THEN '/Docs/' ELSE '/docs//./' END"), F.col("l_orderkey") % 100).alias("path"), (F.col("l_linenumber") % 3).alias("line"))
    return D.locations(rows, "path", ["line"]).groupBy("path").agg(F.count("*").alias("n"))


def debounce_last_event(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each burst of a user, bursts parted by ten minutes of silence."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return edits.bursts(e, "user_id", "ts", "10 minutes", order=["event_id"]).select("user_id", "event_id", F.col("edits").alias("events"))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def diagnostics_merge(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics of two sources for each document, counted by code."""
    s = segments(spark, d)
    return D.diagnostics({"missing": s.where("kind = 5 AND a % 7 = 3"), "orphans": s.where("kind = 3 AND a % 2 = 0")})


def table_grid(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a table's grid: orders are tables of two cells a row, the first of which spans two rows where a number is odd."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    cells = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row"), "q", F.explode(F.array(F.lit(0), F.lit(1))).alias("cell"))
    spans = cells.select("doc_id", "row", "cell", F.when(F.col("cell") == 0, F.lit(1)).otherwise(F.col("q") % 3 + 1).alias("colspan"), F.when((F.col("cell") == 0) & (F.col("q") % 2 == 1), 2).otherwise(1).alias("rowspan"))
    return D.grids(spans)


_S = f"WITH {SEGMENTS}"
SQL = {
    "bib_parse": "SELECT CAST(p_size AS BIGINT) AS bib_id, 'p' || p_partkey AS entry, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS times, 'article' AS type, p_brand || ' and {Sons, Inc}' AS author, '50% off' AS note FROM part",
    "bib_last_wins": "SELECT CAST(p_size AS BIGINT) AS bib_id, 'p' || p_partkey AS entry, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' again' ELSE '' END AS title, 'J. of ' || p_type AS journal, '' || (1900 + p_size) AS year FROM part",
    "bib_key_offsets": "SELECT CAST(p_size AS BIGINT) AS bib_id, 9 AS first, count(*) AS n FROM part GROUP BY 1",
    "citation_definitions": _S + _CITES + """ SELECT c.doc_id, c.key, c.key_start, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' again' ELSE '' END AS title
        FROM c JOIN orders ON o_orderkey = c.doc_id JOIN part ON 'p' || p_partkey = c.key AND p_size = c.doc_id % 50 + 1""",
    "bibliography_usages": _S + _CITES + """ SELECT doc_id % 50 + 1 AS bib_id, key, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS documents, count(*) AS times FROM c JOIN orders ON o_orderkey = doc_id GROUP BY ALL""",
    "affected_documents": "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 50 + 1 IN (SELECT p_size FROM part WHERE p_partkey % 40 = 1)",
    "bib_serialize": "SELECT p_partkey, concat('@article{p', p_partkey, ',', chr(10), '  title = {', p_name, ' \\& 5\\%},', chr(10), '  doi = {10.1/a_', p_partkey, '}', chr(10), '}') AS out FROM part",
    "csl_item": """SELECT p_partkey, concat('{"type":"', CASE WHEN p_partkey % 4 = 0 THEN 'thesis","genre":"PhD thesis' ELSE 'article-journal' END, '","title":"', p_name, '","author":[{"literal":"', p_brand, '"}],',
        CASE WHEN p_partkey % 2 = 0 THEN '"issued":{"date-parts":[[' || (1900 + p_size) || ']]},' ELSE '' END, '"container-title":"', CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Proc.' END, '","page":"', p_size, '"}') AS item FROM part""",
    "front_matter": """SELECT p_partkey, p_name || '|' || p_type AS title, p_brand AS author, 'refs' || p_size || '.bib' AS bibliography, CAST(p_size AS DOUBLE) AS font_size, CAST(NULL AS DOUBLE) AS code_font_size, '+02:00' AS timezone, 'endnotes' AS notes, 'footnotes' AS zotero_notes, CAST(NULL AS VARCHAR) AS csl, 'Body' AS body FROM part""",
    "front_matter_write": "SELECT p_partkey, concat('---', chr(10), 'title: ', p_name, chr(10), 'title: ', p_type, chr(10), 'author: ', p_brand, chr(10), 'zotero-notes: footnotes', chr(10), 'notes: endnotes', chr(10), 'timezone: +02:00', chr(10), 'bibliography: refs', p_size, chr(10), 'font-size: ', p_size, chr(10), '---', chr(10)) AS out FROM part",
    "bib_path_resolution": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'own/' || o_orderkey || '.bib' WHEN o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN 'cust/' || o_custkey || '.bib' ELSE 'default.bib' END AS path FROM orders",
    "citation_key_disambiguate": """WITH x AS (SELECT DISTINCT l_suppkey AS scope, l_partkey AS item FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY scope, item % 3 ORDER BY item) AS n FROM x)
        SELECT scope, item, 'k' || CASE WHEN n = 1 THEN '' || (item % 3) ELSE '' END || CASE WHEN n = 1 THEN '' ELSE (item % 3) || '' || n END AS key FROM y""",
    "first_appearance_renumber": _S + """, n AS (SELECT doc_id, CASE WHEN a % 4 = 0 THEN '' || (a % 5 + 1) ELSE 'n' || (a % 7) END AS name, min(ord) AS pos FROM segs GROUP BY 1, 2),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, name) AS k FROM n WHERE starts_with(name, 'n')),
        g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT DISTINCT doc_id FROM n), (SELECT unnest(range(1, 40)) AS i) WHERE (doc_id, '' || i) NOT IN (SELECT (doc_id, name) FROM n))
        SELECT f.doc_id, f.name, g.i AS number FROM f JOIN g USING (doc_id, k) UNION ALL SELECT doc_id, name, CAST(name AS BIGINT) FROM n WHERE NOT starts_with(name, 'n')""",
    "note_orphans": _S + """, rf AS (SELECT DISTINCT doc_id, a % 6 AS label FROM segs WHERE kind < 4), f AS (SELECT DISTINCT doc_id, a % 6 AS label FROM segs WHERE kind >= 4)
        SELECT doc_id, label, 'undefined' AS problem FROM (FROM rf EXCEPT FROM f) UNION ALL SELECT doc_id, label, 'unused' FROM (FROM f EXCEPT FROM rf)""",
    "reply_roots": "SELECT conv_id * 1000 + turn AS id, conv_id * 1000 AS root, turn AS depth FROM conversations",
    "thread_texts": "SELECT conv_id, md5(string_agg('{>>' || role || ': ' || text || '<<}', '' ORDER BY turn)) AS hash, arg_min(role, turn) AS author FROM conversations GROUP BY conv_id",
    "run_merge": _S + """, x AS (SELECT doc_id, ord, a, kind % 2 = 0 AS bold, color = 'red' AS r FROM segs), y AS (SELECT *, coalesce(bold <> lag(bold) OVER w OR r <> lag(r) OVER w, true)::INT AS c FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
        z AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM y) SELECT doc_id, CAST(island AS BIGINT) AS island, bool_and(bold) AS bold, string_agg('' || a, '' ORDER BY ord) AS text FROM z GROUP BY doc_id, island""",
    "code_block_group": _S + """, x AS (SELECT doc_id, ord, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM segs WHERE kind >= 5), y AS (SELECT doc_id, min(ord) AS o, count(*) AS lines FROM x GROUP BY doc_id, g)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS block, lines FROM y""",
    "rowspans": """WITH x AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS col, l_linenumber AS r, max(l_quantity) % 2 = 0 AS cont FROM lineitem GROUP BY 1, 2, 3),
        y AS (SELECT *, max(CASE WHEN cont THEN NULL ELSE r END) OVER (PARTITION BY doc_id, col ORDER BY r) AS head FROM x) SELECT doc_id, col, CAST(head AS BIGINT) AS "row", count(*) AS rowspan FROM y WHERE head IS NOT NULL GROUP BY doc_id, col, head""",
    "comment_transitions": _S + """, x AS (SELECT doc_id, ord, list_distinct([a % 3, b % 3]) AS ids FROM segs), y AS (SELECT *, coalesce(lag(ids) OVER (PARTITION BY doc_id ORDER BY ord), []) AS was FROM x)
        SELECT doc_id, ord, array_to_string(list_sort(list_filter(ids, lambda v: NOT list_contains(was, v))), ',') AS opens, array_to_string(list_sort(list_filter(was, lambda v: NOT list_contains(ids, v))), ',') AS closes FROM y""",
    "list_spacing": _S + """, x AS (SELECT doc_id, ord, CASE WHEN kind < 3 THEN 1 WHEN kind < 5 THEN 2 ELSE 0 END AS l FROM segs), y AS (SELECT l, lag(l) OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM x)
        SELECT CASE WHEN l > 0 AND l = coalesce(p, -1) THEN 'same list' WHEN l > 0 THEN 'new list' ELSE 'text' END AS gap, count(*) AS n FROM y GROUP BY 1""",
    "label_sort": "SELECT p_size, CASE WHEN p_partkey % 3 = 0 THEN 'n' || p_partkey ELSE '' || p_partkey END AS label, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 3 = 0, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END, 'n' || p_partkey) AS place FROM part",
    "style_suggestions": """WITH k AS (SELECT p_partkey AS i, p_name AS style FROM part), q AS (SELECT * FROM (VALUES ('red'), ('bolt'), ('small ring'), ('zzz')) t(name) WHERE name NOT IN (SELECT style FROM k)),
        x AS (SELECT name, style, row_number() OVER (PARTITION BY name ORDER BY i) AS place FROM q JOIN k ON contains(style, name)) SELECT * FROM x WHERE place <= 3""",
    "key_locale_sort": """WITH x AS (SELECT p_size, p_partkey, [1, 1, 2, 2, 3, 3, 5, 4, 4, 4][p_partkey % 10 + 1] AS base, [0, 1, 0, 1, 0, 1, 0, 1, 0, 1][p_partkey % 10 + 1] AS variant,
        ['a', 'A', 'ä', 'Ä', 'b', 'B', 'z', 'é', 'e', 'E'][p_partkey % 10 + 1] || lpad('' || p_partkey, 7, '0') AS key FROM part)
        SELECT p_size, key, row_number() OVER (PARTITION BY p_size ORDER BY CASE base WHEN 2 THEN 1 ELSE base END, p_partkey) AS place FROM x""",
    "map_merge": """WITH r AS (SELECT DISTINCT n_regionkey, n_nationkey % 3 AS k, n_nationkey % 3 + 200 AS v FROM nation), l AS (SELECT DISTINCT n_regionkey, n_nationkey % 4 AS k, n_nationkey % 4 + 100 AS v FROM nation)
        FROM r UNION ALL SELECT * FROM l WHERE (n_regionkey, k) NOT IN (SELECT (n_regionkey, k) FROM r)""",
    "location_dedupe": "SELECT path, count(*) AS n FROM (SELECT DISTINCT '/docs/' || (l_orderkey % 100) AS path, l_linenumber % 3 FROM lineitem) GROUP BY path",
    "debounce_last_event": """WITH x AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 10 MINUTE, true)::INT AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x)
        SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS events FROM y GROUP BY user_id, s""",
    "latest_version": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "diagnostics_merge": _S + " SELECT doc_id, count(*) FILTER (kind = 5) AS missing, count(*) FILTER (kind = 3) AS orphans FROM segs WHERE kind = 5 AND a % 7 = 3 OR kind = 3 AND a % 2 = 0 GROUP BY doc_id",
    "table_grid": """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, CAST(max(l_quantity) AS INT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
        x AS (SELECT doc_id, n, q, coalesce(lag(q) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1, false)::INT AS pushed FROM r)
        SELECT doc_id, CAST(max(pushed + 1 + q % 3 + 1) AS BIGINT) AS columns FROM x GROUP BY doc_id""",
}
QUERIES = {k: globals()[k] for k in SQL}
