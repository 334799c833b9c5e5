"""Queries on contexts, positional joins, stored properties, outputs and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import markdown, scan
from scriptorium.functions import text as T
from scriptorium.functions.offsets import at_every_place, matches
from scriptorium.operators import documents as D
from scriptorium.plans.planted import SEGMENTS, manuscripts, segments
from scriptorium.sources import files
from scriptorium.session import table


def adjacent_comments(spark: SparkSession, d: str) -> DataFrame:
    """A comment belongs to the annotated element before it."""
    out = D.adjacent(segments(spark, d), F.col("kind") == 3, F.col("kind").isin(0, 1, 2, 4))
    return out.select("doc_id", "ord", "target")


def positional_fields(spark: SparkSession, d: str) -> DataFrame:
    """The n-th field of a document is its n-th citation, also where one of them can't be read."""
    s = segments(spark, d).where("kind = 5")
    json = F.expr("CASE WHEN a % 6 = 0 THEN '{broken' ELSE concat('{\"key\":\"p', a, '\"}') END")
    return D.by_position(s.select("doc_id", "ord"), s.select("doc_id", "ord", D.stored_text(json, "key").alias("key")))


def stored_properties(spark: SparkSession, d: str) -> DataFrame:
    """Numbered chunks of a JSON map put together and read; values that are no strings go."""
    p = table(spark, d, "part")
    whole = F.expr("concat('{\"a\":\"', p_name, '\",\"b\":', p_size, ',\"c\":\"', p_brand, '\"', CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '}' END)")
    chunks = p.select("p_partkey", F.posexplode(T.chunks(whole, 7)).alias("i", "c"))
    return D.joined_chunks(chunks, "p_partkey").select("p_partkey", *[D.stored_text(F.col("value"), k).alias(k) for k in "abc"])


def restored_ids(spark: SparkSession, d: str) -> DataFrame:
    """Original identifiers where they are stored and free, new numbers elsewhere; some stored ones are numbers."""
    s = segments(spark, d).where("kind = 3")
    stored = F.when(F.col("a") % 4 == 0, F.concat(F.lit("c"), F.col("a") % 3)).when(F.col("a") % 4 == 1, (F.col("a") % 2 + 1).cast("string"))
    return D.restored_names(s.select("doc_id", "ord", stored.alias("stored"))).select("doc_id", "ord", "id")


def item_keys(spark: SparkSession, d: str) -> DataFrame:
    key = "concat('AB', lpad(p_size, 4, '0'), 'CD')"
    uri = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN concat('http://zotero.org/users/1/items/', {key}) WHEN 1 THEN concat('http://zotero.org/groups/2/items/', {key}, '/x') WHEN 2 THEN concat('http://zotero.org/users/local/x/items/Q', p_size) ELSE 'http://other.example/' END")
    style = F.expr("CASE p_partkey % 2 WHEN 0 THEN concat('http://www.zotero.org/styles/', p_brand) ELSE p_brand END")
    return table(spark, d, "part").select("p_partkey", D.item_key(uri).alias("key"), D.style_name(style).alias("style"), D.style_address(style).alias("address"))


def text_documents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    language = F.element_at(F.array(*map(F.lit, ["markdown", "plaintext", "bibtex", "yaml"])), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", language.alias("language")).where(F.col("language").isin(*D.TEXT_LANGUAGES)).groupBy("language").agg(F.count("*").alias("n"))


def dollar_runs(spark: SparkSession, d: str) -> DataFrame:
    m = matches(table(spark, d, "documents"), r"\$+")
    return m.groupBy(F.length("match").cast("long").alias("length")).agg(F.count("*").alias("n"), F.max("start").alias("last"))


def style_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN p_name WHEN 2 THEN concat('../', p_brand) ELSE lower(p_type) END")
    tag = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'de' ELSE 'EN_us' END")
    return table(spark, d, "part").select("p_partkey", name.rlike(D.STYLE_NAME).alias("style_ok"), tag.rlike(D.LOCALE_TAG).alias("locale_ok"))


def comment_at_offset(spark: SparkSession, d: str) -> DataFrame:
    """The identifier of the comment whose body has a place in it, and the text that it is about, at every place."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr("concat('{#c', p_size, '}', p_name, '{/c', p_size, '}{#c', p_size, '>>say {>>more<<} on<<} end')").alias("text"))
    ranges = scan.rows_from(t, scan.comment_ranges, "start long, end long, id string, about string", only_if=r"\{#").drop("no")
    return at_every_place(t, ranges).select("doc_id", "place", "id", "about")


def reply_lists(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr("concat('main ', p_size, '  {>>one {>>deep<<}<<} {>>two', p_partkey, '<<} {>>open')").alias("text"))
    return scan.rows_from(t, lambda s: [(markdown.replies(s)[0], r) for r in markdown.replies(s)[1]], "parent string, reply string").select("doc_id", F.col("no").alias("n"), "parent", "reply")


def output_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.expr("concat('/w/', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.md' ELSE '.txt' END)")
    return table(spark, d, "part").select("p_partkey", files.base_path(p).alias("base"), files.direction(p).alias("direction"), files.conflict(F.expr("p_size % 2 = 0"), F.expr("p_size % 3 = 0")).alias("conflict"))


def field_context(spark: SparkSession, d: str) -> DataFrame:
    """The value of the first style line in front matter, and where it stands."""
    t = F.expr("concat('---\n', CASE WHEN p_partkey % 2 = 0 THEN concat('title: ', p_name, '\n') ELSE '' END, 'csl: \"', p_type, '\"\ncsl: second\n---\nbody')")
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), D.style_field(t).alias("x")).select("doc_id", "x.value", "x.start", "x.end")


def typing_edits(spark: SparkSession, d: str) -> DataFrame:
    """Whether all changes of an edit are typed."""
    e = table(spark, d, "events")
    changes = F.array(*[F.struct(F.expr(f"repeat('x', CAST((event_id + {k}) % 3 AS INT))").alias("text"), F.expr(f"(event_id * 3 + {k}) % 2").alias("removed")) for k in range(2)])
    return e.select("event_id", D.typed(changes).alias("typed")).groupBy("typed").agg(F.count("*").alias("n"))


_S = f"WITH {SEGMENTS}"
SQL = {
    "adjacent_comments": _S + """, x AS (SELECT doc_id, ord, kind, max(CASE WHEN kind IN (0, 1, 2, 4) THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM segs) SELECT doc_id, ord, target FROM x WHERE kind = 3""",
    "positional_fields": _S + " SELECT doc_id, ord, CASE WHEN a % 6 <> 0 THEN 'p' || a END AS key FROM segs WHERE kind = 5",
    "stored_properties": "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS a, CAST(NULL AS VARCHAR) AS b, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS c FROM part",
    "restored_ids": _S + """, x AS (SELECT doc_id, ord, CASE WHEN a % 4 = 0 THEN 'c' || (a % 3) WHEN a % 4 = 1 THEN '' || (a % 2 + 1) END AS st FROM segs WHERE kind = 3),
        y AS (SELECT *, st IS NOT NULL AND ord = min(ord) OVER (PARTITION BY doc_id, st) AS own FROM x),
        f AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM y WHERE NOT own),
        g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT DISTINCT doc_id FROM y), (SELECT unnest(range(1, 40)) AS i) WHERE (doc_id, '' || i) NOT IN (SELECT (doc_id, st) FROM y WHERE st IS NOT NULL))
        SELECT doc_id, ord, st AS id FROM y WHERE own UNION ALL SELECT doc_id, ord, '' || i FROM f JOIN g USING (doc_id, k)""",
    "item_keys": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'AB' || lpad('' || p_size, 4, '0') || 'CD' END AS key, p_brand AS style,
        'http://www.zotero.org/styles/' || p_brand AS address FROM part""",
    "text_documents": "SELECT CASE event_id % 4 WHEN 0 THEN 'markdown' ELSE 'plaintext' END AS language, count(*) AS n FROM events WHERE event_id % 4 < 2 GROUP BY 1",
    "dollar_runs": """WITH p AS (SELECT regexp_split_to_array(text, '\\$+') AS g, regexp_extract_all(text, '\\$+') AS m FROM documents WHERE contains(text, '$')),
        c AS (SELECT g, m, unnest(range(1, len(m) + 1)) AS i FROM p), x AS (SELECT length(m[i]) AS l, list_sum(list_transform(g[1:i], lambda a: length(a))) + coalesce(list_sum(list_transform(m[1:i-1], lambda a: length(a))), 0) AS s FROM c)
        SELECT CAST(l AS BIGINT) AS length, count(*) AS n, CAST(max(s) AS BIGINT) AS last FROM x GROUP BY l""",
    "style_names": "SELECT p_partkey, p_partkey % 4 = 0 OR (p_partkey % 4 = 1 AND NOT contains(p_name, ' ')) OR (p_partkey % 4 = 3 AND NOT contains(p_type, ' ')) AS style_ok, p_partkey % 3 < 2 AS locale_ok FROM part",
    "comment_at_offset": """WITH x AS (SELECT p_partkey, p_name, 'c' || p_size AS id, length('c' || p_size) AS k, length(p_name) AS l FROM part),
        y AS (SELECT *, 2 * k + 6 + l AS s, 2 * k + 6 + l + k + 24 AS e FROM x), z AS (SELECT *, unnest(range(0, e + 4)) AS place FROM y)
        SELECT p_partkey AS doc_id, place, id, p_name AS about FROM z WHERE place >= s AND place < e""",
    "reply_lists": "SELECT p_partkey AS doc_id, 0 AS n, 'main ' || p_size AS parent, 'one {>>deep<<}' AS reply FROM part UNION ALL SELECT p_partkey, 1, 'main ' || p_size, 'two' || p_partkey FROM part",
    "output_paths": """SELECT p_partkey, '/w/' || p_partkey || CASE WHEN p_partkey % 3 = 2 THEN '.txt' ELSE '' END AS base, CASE p_partkey % 3 WHEN 0 THEN 'to_markdown' WHEN 1 THEN 'to_docx' END AS direction,
        CASE WHEN p_size % 6 = 0 THEN 'both' WHEN p_size % 2 = 0 THEN 'md' WHEN p_size % 3 = 0 THEN 'bib' ELSE 'none' END AS conflict FROM part""",
    "field_context": "WITH x AS (SELECT p_partkey, p_type, 4 + CASE WHEN p_partkey % 2 = 0 THEN 8 + length(p_name) ELSE 0 END + 6 AS s FROM part) SELECT p_partkey AS doc_id, p_type AS value, s AS start, s + length(p_type) AS \"end\" FROM x",
    "typing_edits": """SELECT event_id % 3 + event_id * 3 % 2 = 1 AND (event_id + 1) % 3 + (event_id * 3 + 1) % 2 = 1 AS typed, count(*) AS n FROM events GROUP BY 1""",
}
QUERIES = {k: globals()[k] for k in SQL}
