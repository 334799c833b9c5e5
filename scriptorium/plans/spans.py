"""Queries on annotations in planted manuscripts and on comments, links and words of real text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import scan
from scriptorium.functions import text as T
from scriptorium.functions.offsets import around, at_every_place, matches, merged, overlap_pairs
from scriptorium.plans.planted import BIB_WHERE, SEGMENTS, bibliography, manuscripts
from scriptorium.session import table

ADDITION, DELETION, SUBSTITUTION, COMMENT = r"\{\+\+[\s\S]*?\+\+\}", r"\{--[\s\S]*?--\}", r"\{~~[\s\S]*?~~\}", r"\{>>[\s\S]*?<<\}"
DELIMITER = r"\{\+\+|\+\+\}|\{--|--\}|\{~~|~~\}"


def _content(df: DataFrame, pattern: str) -> DataFrame:
    m = matches(df, pattern)
    return m.select("doc_id", (F.col("start") + 3).alias("start"), (F.col("end") - 3).alias("end")).where("end > start")


def span_additions(spark: SparkSession, d: str) -> DataFrame:
    return _content(manuscripts(spark, d), ADDITION)


def span_deletions(spark: SparkSession, d: str) -> DataFrame:
    return _content(manuscripts(spark, d), DELETION)


def span_comments(spark: SparkSession, d: str) -> DataFrame:
    return _content(manuscripts(spark, d), COMMENT)


def span_substitution_new(spark: SparkSession, d: str) -> DataFrame:
    m = matches(manuscripts(spark, d), r"\{~~[\s\S]*?~>[\s\S]*?~~\}")
    return m.select("doc_id", (F.col("start") + F.instr("match", "~>") + 1).alias("start"), (F.col("end") - 3).alias("end")).where("end > start")


def span_delimiters(spark: SparkSession, d: str) -> DataFrame:
    docs = manuscripts(spark, d)
    arrows = matches(docs, SUBSTITUTION).where(F.instr("match", "~>").between(1, F.length("match") - 3))
    arrow = F.col("start") + F.instr("match", "~>") - 1
    return matches(docs, DELIMITER).select("doc_id", "start", "end").unionByName(arrows.select("doc_id", arrow.alias("start"), (arrow + 2).alias("end")))


_COLORS = frozenset(n for n, _, _ in T.PALETTE)


def highlight_by_color(spark: SparkSession, d: str) -> DataFrame:
    found = scan.rows_from(manuscripts(spark, d), lambda t: scan.highlights(t, _COLORS), "color string, start long, end long", only_if="==")
    return found.groupBy("color").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def decoration_kinds(spark: SparkSession, d: str) -> DataFrame:
    found = scan.rows_from(manuscripts(spark, d), lambda t: scan.decorations(t, _COLORS), "kind string, start long, end long", only_if=r"==|\{")
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def code_regions(spark: SparkSession, d: str) -> DataFrame:
    return scan.rows_from(manuscripts(spark, d), scan.code_regions, "start long, end long", only_if="`|~~~").drop("no")


def navigation(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end`` of the annotations outside code, each text read once."""

    def found(text: str) -> list[tuple[int, int]]:
        code = scan.code_regions(text)
        return [(s, e) for _, s, e in scan.marks(text) if not scan.overlaps(code, s, e)]

    return scan.rows_from(docs, found, "start long, end long", only_if="[{~<]|==").drop("no")


def nav_matches(spark: SparkSession, d: str) -> DataFrame:
    return navigation(manuscripts(spark, d))


def syntax_scopes(spark: SparkSession, d: str) -> DataFrame:
    found = scan.rows_from(manuscripts(spark, d), scan.scopes, "scope string, start long, end long", only_if=r"[{\[]|==")
    return found.groupBy("scope").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


def nav_next_prev(spark: SparkSession, d: str) -> DataFrame:
    return around(nav_matches(spark, d), F.lit(30))


def citations(docs: DataFrame, skip_code: bool = True) -> DataFrame:
    """``doc_id, cluster, key, key_start, key_end`` of every citation key within brackets outside code; ``cluster`` is where the bracket opens."""

    def found(text: str) -> list[tuple[int, str, int, int]]:
        if skip_code:
            text = scan.blank_regions(text, scan.code_regions(text))
        return [(opened, key, at, at + len(key)) for opened, key, at in scan.citation_keys(text)]

    return scan.rows_from(docs, found, "cluster long, key string, key_start long, key_end long", only_if="@").drop("no")


def citation_usages(spark: SparkSession, d: str) -> DataFrame:
    return citations(manuscripts(spark, d)).drop("cluster")


def citation_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    return citations(manuscripts(spark, d)).join(bibliography(spark, d), "key", "left_anti").select("doc_id", "key", "key_start")


def usages_of_key(spark: SparkSession, d: str) -> DataFrame:
    return citations(manuscripts(spark, d)).where(F.col("key") == "p7").select("doc_id", "key_start", "key_end")


def key_at_offset(spark: SparkSession, d: str) -> DataFrame:
    """The key at every place of each manuscript: texts are scanned once, ranges joined to their texts' lengths and unfolded."""
    docs = manuscripts(spark, d)
    ranges_ = scan.rows_from(docs, scan.key_ranges, "start long, end long, key string", only_if="@").drop("no")
    return at_every_place(docs, ranges_).select("doc_id", "place", "key")


def bibliography_filter(spark: SparkSession, d: str) -> DataFrame:
    return bibliography(spark, d).join(citations(manuscripts(spark, d)).select("key"), "key", "left_semi").select("key", "title")


def citation_cluster_status(spark: SparkSession, d: str) -> DataFrame:
    c = citations(manuscripts(spark, d)).join(bibliography(spark, d).select("key", F.lit(True).alias("found")), "key", "left")
    g = c.groupBy("doc_id", "cluster").agg(F.bool_and(F.col("found").isNotNull()).alias("every"), F.bool_or(F.col("found").isNotNull()).alias("some"))
    return g.select("doc_id", "cluster", F.when(F.col("every"), "resolved").when(F.col("some"), "mixed").otherwise("missing").alias("status"))


def find_references(spark: SparkSession, d: str) -> DataFrame:
    c = citations(manuscripts(spark, d)).dropDuplicates(["doc_id", "key", "key_start"])
    return bibliography(spark, d).select("key").join(c.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")), "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("docs", F.lit(0)).alias("docs"))


def distinct_cited(spark: SparkSession, d: str) -> DataFrame:
    return citations(manuscripts(spark, d)).select("key").distinct()


def completion_prefix(spark: SparkSession, d: str) -> DataFrame:
    b = bibliography(spark, d)
    return b.where(F.startswith(F.lower("key"), F.lit("p12")) | F.lower("title").contains("red bolt")).select("key", "title")


def completion_context(spark: SparkSession, d: str) -> DataFrame:
    """What has been typed of a key at the first ``;`` after each ``@`` of a manuscript."""
    places = F.regexp_extract_all("text", F.lit(r"@([A-Za-z0-9_:-]*);"), F.lit(1))
    return manuscripts(spark, d).select("doc_id", F.posexplode(places).alias("no", "prefix")).select("doc_id", F.col("no").cast("long").alias("no"), "prefix")


def has_citations(spark: SparkSession, d: str) -> DataFrame:
    return manuscripts(spark, d).groupBy(F.col("text").rlike(r"\[@[^\]]+\]").alias("cited")).agg(F.count("*").alias("n"))


def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    out = scan.text_from(manuscripts(spark, d), scan.strip_marks, "out")
    return out.select("doc_id", F.length("out").alias("chars"), F.md5("out").alias("hash"))


def inert_zones(spark: SparkSession, d: str) -> DataFrame:
    return scan.rows_from(manuscripts(spark, d), scan.inert_zones, "start long, end long", only_if=r"[`~{$<]").drop("no")


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of comments, ``doc_id, name, start, end``, made from lines of orders."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("name"), F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + 3 + F.col("l_linenumber")).alias("end"))
    return rows.distinct()


def merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    return merged(ranges(spark, d))


def html_comment_spans(spark: SparkSession, d: str) -> DataFrame:
    return matches(table(spark, d, "pages"), "<!--[\\s\\S]*?-->", "page_id", "html").select("page_id", "start", "end")


def anchor_targets(spark: SparkSession, d: str) -> DataFrame:
    m = matches(table(spark, d, "pages"), '<a href="[^"]*">', "page_id", "html")
    return m.groupBy(T.href(F.regexp_extract("match", '"([^"]*)"', 1)).alias("href")).agg(F.count("*").alias("n"))


def bare_at_context(spark: SparkSession, d: str) -> DataFrame:
    """An ``@`` that begins a bare citation: at the start, or after a character that ends no word."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_.@])@[A-Za-z0-9_]"), F.lit(0))).alias("bare"), (F.length("text") - F.length(F.replace("text", F.lit("@"), F.lit("")))).alias("every")).where("every > 0")


def comment_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap_pairs(ranges(spark, d)).distinct().select("doc_id", "name", "other")


_S = f"WITH {SEGMENTS}"
_CITES = """, c AS (SELECT doc_id, s AS cluster, 'p' || a AS key, s + 2 AS key_start, s + 2 + length('p' || a) AS key_end FROM segs WHERE kind = 5
 UNION ALL SELECT doc_id, s, 'p' || b, s + 2 + length('p' || a) + 7, s + 2 + length('p' || a) + 7 + length('p' || b) FROM segs WHERE kind = 5),
 bib AS (SELECT 'p' || p_partkey AS key, p_name AS title FROM part WHERE """ + BIB_WHERE + ")"
_NAV = ", nav AS (SELECT doc_id, s AS start, s + length(seg) AS \"end\" FROM segs WHERE kind < 5)"

SQL = {
    "span_additions": _S + ' SELECT doc_id, s + 3 AS start, s + length(seg) - 3 AS "end" FROM segs WHERE kind = 0',
    "span_deletions": _S + ' SELECT doc_id, s + 3 AS start, s + length(seg) - 3 AS "end" FROM segs WHERE kind = 1',
    "span_comments": _S + ' SELECT doc_id, s + 3 AS start, s + length(seg) - 3 AS "end" FROM segs WHERE kind = 3',
    "span_substitution_new": _S + " SELECT doc_id, s + 8 + length(CAST(b AS VARCHAR)) AS start, s + length(seg) - 3 AS \"end\" FROM segs WHERE kind = 2",
    "span_delimiters": _S + """ SELECT doc_id, s AS start, s + 3 AS "end" FROM segs WHERE kind < 3
        UNION ALL SELECT doc_id, s + length(seg) - 3, s + length(seg) FROM segs WHERE kind < 3
        UNION ALL SELECT doc_id, s + 6 + length(CAST(b AS VARCHAR)), s + 8 + length(CAST(b AS VARCHAR)) FROM segs WHERE kind = 2""",
    "highlight_by_color": _S + " SELECT CASE color WHEN 'nocolor' THEN 'yellow' ELSE color END AS color, count(*) AS n, CAST(sum(length(seg)) AS BIGINT) AS chars FROM segs WHERE kind = 4 GROUP BY 1",
    "decoration_kinds": _S + """, k AS (SELECT 'addition' AS kind, s + 3 AS s FROM segs WHERE kind = 0 UNION ALL SELECT 'deletion', s + 3 FROM segs WHERE kind = 1
        UNION ALL SELECT 'substitution_new', s + 8 + length(CAST(b AS VARCHAR)) FROM segs WHERE kind = 2 UNION ALL SELECT 'comment', s + 3 FROM segs WHERE kind = 3
        UNION ALL SELECT 'highlight:' || CASE color WHEN 'nocolor' THEN 'yellow' ELSE color END, s FROM segs WHERE kind = 4)
        SELECT kind, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts FROM k GROUP BY 1""",
    "code_regions": _S + ' SELECT doc_id, s AS start, s + length(seg) AS "end" FROM segs WHERE kind = 6',
    "syntax_scopes": _S + """ SELECT CASE kind WHEN 0 THEN 'addition' WHEN 1 THEN 'deletion' WHEN 2 THEN 'substitution' WHEN 3 THEN 'comment' WHEN 4 THEN 'coloured_highlight' ELSE 'citations' END AS scope,
        count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(s + length(seg)) AS BIGINT) AS ends FROM segs WHERE kind < 6 GROUP BY 1""",
    "nav_matches": _S + _NAV + " SELECT * FROM nav",
    "nav_next_prev": _S + _NAV + """ SELECT doc_id, coalesce(min(start) FILTER (start > 30), min(start)) AS next_start, coalesce(max(start) FILTER (start < 30), max(start)) AS prev_start FROM nav GROUP BY doc_id""",
    "citation_usages": _S + _CITES + " SELECT doc_id, key, key_start, key_end FROM c",
    "citation_missing_keys": _S + _CITES + " SELECT doc_id, key, key_start FROM c WHERE key NOT IN (SELECT key FROM bib)",
    "usages_of_key": _S + _CITES + " SELECT doc_id, key_start, key_end FROM c WHERE key = 'p7'",
    "key_at_offset": _S + """, c AS (SELECT doc_id, 'p' || a AS key, s + 2 AS key_start, s + 2 + length('p' || a) AS key_end FROM segs WHERE kind = 5
        UNION ALL SELECT doc_id, 'p' || b, s + 2 + length('p' || a) + 7, s + 2 + length('p' || a) + 7 + length('p' || b) FROM segs WHERE kind = 5
        UNION ALL SELECT doc_id, 'p1', s + 8, s + 10 FROM segs WHERE kind = 6),
        k AS (SELECT *, unnest(range(key_start - 1, key_end + 1)) AS place FROM c)
        SELECT doc_id, place, key FROM k""",
    "merged_ranges": """WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS name, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + 3 + l_linenumber AS e FROM lineitem),
        b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
        i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
        SELECT doc_id, min(s) AS start, max(e) AS "end" FROM i GROUP BY doc_id, island""",
    "bibliography_filter": _S + _CITES + " SELECT key, title FROM bib WHERE key IN (SELECT key FROM c)",
    "citation_cluster_status": _S + _CITES + """ SELECT doc_id, cluster, CASE WHEN bool_and(f) THEN 'resolved' WHEN bool_or(f) THEN 'mixed' ELSE 'missing' END AS status
        FROM (SELECT c.*, key IN (SELECT key FROM bib) AS f FROM c) GROUP BY doc_id, cluster""",
    "find_references": _S + _CITES + " SELECT bib.key, count(c.key) AS n, count(DISTINCT c.doc_id) AS docs FROM bib LEFT JOIN c ON c.key = bib.key GROUP BY bib.key",
    "distinct_cited": _S + _CITES + " SELECT DISTINCT key FROM c",
    "completion_prefix": "SELECT 'p' || p_partkey AS key, p_name AS title FROM part WHERE " + BIB_WHERE + " AND (starts_with('p' || p_partkey, 'p12') OR contains(lower(p_name), 'red bolt'))",
    "completion_context": _S + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS no, 'p' || a AS prefix FROM segs WHERE kind = 5",
    "has_citations": _S + " SELECT cited, count(*) AS n FROM (SELECT doc_id, bool_or(kind IN (5, 6)) AS cited FROM segs GROUP BY doc_id) GROUP BY cited",
    "strip_markup": _S + """, o AS (SELECT doc_id, ord, CASE kind WHEN 0 THEN 'add' || a WHEN 1 THEN 'del' || a WHEN 2 THEN 'old' || b || '~>new' || a WHEN 3 THEN '' ELSE seg END AS x FROM segs),
        j AS (SELECT doc_id, trim(string_agg(x, ' ' ORDER BY ord)) AS out FROM o GROUP BY doc_id) SELECT doc_id, length(out) AS chars, md5(out) AS hash FROM j""",
    "inert_zones": _S + ' SELECT doc_id, s AS start, s + length(seg) AS "end" FROM segs WHERE kind IN (0, 1, 2, 3, 6)',
    "html_comment_spans": """WITH p AS (SELECT page_id, regexp_split_to_array(html, '<!--(?s:.*?)-->') AS g, regexp_extract_all(html, '<!--(?s:.*?)-->') AS m FROM pages),
        x AS (SELECT page_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM p WHERE len(m) > 0)
        SELECT page_id, CAST(list_sum(list_transform(g[1:i], lambda a: length(a))) + coalesce(list_sum(list_transform(m[1:i-1], lambda a: length(a))), 0) AS BIGINT) AS start,
               CAST(list_sum(list_transform(g[1:i], lambda a: length(a))) + list_sum(list_transform(m[1:i], lambda a: length(a))) AS BIGINT) AS "end" FROM x""",
    "anchor_targets": """WITH m AS (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS h FROM pages)
        SELECT CASE WHEN regexp_matches(h, '[()\\[\\]\\s\\x{0B}\\x{A0}]') THEN '<' || h || '>' ELSE h END AS href, count(*) AS n FROM m GROUP BY 1""",
    "bare_at_context": """SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.@])@[A-Za-z0-9_]')) AS bare, length(text) - length(replace(text, '@', '')) AS "every" FROM documents WHERE contains(text, '@')""",
    "comment_overlaps": """WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS name, CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + 3 + l_linenumber AS e FROM lineitem)
        SELECT DISTINCT a.doc_id, a.name, b.name AS other FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.name < b.name AND a.s < b.e AND b.s < a.e""",
}
QUERIES = {k: globals()[k] for k in SQL}
