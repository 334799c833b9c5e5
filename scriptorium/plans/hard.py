"""Queries over manuscripts that are hard to scan: fences with other fences in them and longer or no closes,
nested comments, highlights in additions, runs of backticks without a partner, spans over several lines.

As in ``planted.py``, each order is a manuscript and each of its lines a segment, joined by line breaks;
every fifth manuscript ends in a fence that is never closed. The SQL knows where each segment stands and
what is in it, and scans nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import scan
from scriptorium.functions import text as T
from scriptorium.plans.planted import ORDER
from scriptorium.plans.spans import citations, navigation
from scriptorium.session import table

KIND = "(l_orderkey + l_linenumber) % 7"
SEG = f"""CASE {KIND}
 WHEN 0 THEN concat('```', chr(10), '{{++a', l_partkey, '++}}', chr(10), '`````')
 WHEN 1 THEN concat('~~~x', chr(10), '```', chr(10), '[@k', l_partkey, ']', chr(10), '~~~')
 WHEN 2 THEN concat('{{>>a{{>>b', l_partkey, '<<}}c<<}}')
 WHEN 3 THEN concat('{{++x ==h', l_partkey, '== y++}}')
 WHEN 4 THEN concat('u', repeat('`', CAST(ord AS INT)), l_partkey)
 WHEN 5 THEN concat('[@p', l_partkey, chr(10), '; @q', l_suppkey, ']')
 ELSE concat('{{~~old', chr(10), chr(10), 'new~>z', l_partkey, '~~}} {{#c1}}t{{/c1}}{{#c1>>say<<}}') END"""
LAST = "concat('```', chr(10), 'open {++x++}')"

_ROWS = f"""n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS ord FROM lineitem),
 r AS (SELECT l_orderkey AS doc_id, {KIND} AS kind, l_partkey AS a, l_suppkey AS b, {SEG} AS seg, ord FROM n
       UNION ALL SELECT DISTINCT l_orderkey, 7, 0, 0, {LAST}, 1000 FROM lineitem WHERE l_orderkey % 5 = 0)"""
SEGMENTS = f"{_ROWS}, segs AS (SELECT *, CAST(coalesce(sum(length(seg) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM r)"

_COLORS = frozenset(n for n, _, _ in T.PALETTE)


def manuscripts(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("hard_lines")
    rows = spark.sql(f"WITH {_ROWS.replace('FROM lineitem', 'FROM hard_lines')} SELECT doc_id, ord, seg FROM r")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "seg"))), lambda x: x.seg), "\n").alias("text"))


def hard_code_regions(spark: SparkSession, d: str) -> DataFrame:
    return scan.rows_from(manuscripts(spark, d), scan.code_regions, "start long, end long", only_if="`|~~~").drop("no")


def hard_navigation(spark: SparkSession, d: str) -> DataFrame:
    return navigation(manuscripts(spark, d))


def hard_citations(spark: SparkSession, d: str) -> DataFrame:
    return citations(manuscripts(spark, d))


def hard_decorations(spark: SparkSession, d: str) -> DataFrame:
    found = scan.rows_from(manuscripts(spark, d), lambda t: scan.decorations(t, _COLORS), "kind string, start long, end long")
    return found.select("doc_id", "kind", "start", "end")


def hard_strip(spark: SparkSession, d: str) -> DataFrame:
    out = scan.text_from(manuscripts(spark, d), scan.strip_marks, "out")
    return out.select("doc_id", F.length("out").cast("long").alias("chars"), F.md5("out").alias("hash"))


_S = f"WITH {SEGMENTS}"
SQL = {
    "hard_code_regions": _S + ' SELECT doc_id, s AS start, s + length(seg) AS "end" FROM segs WHERE kind IN (0, 1, 7)',
    "hard_navigation": _S + """, x AS (SELECT *, length('' || a) AS k FROM segs)
        SELECT doc_id, s AS start, s + 11 + k AS "end" FROM x WHERE kind = 2 UNION ALL SELECT doc_id, s, s + length(seg) FROM x WHERE kind = 3
        UNION ALL SELECT doc_id, s, s + 17 + k FROM x WHERE kind = 6 UNION ALL SELECT doc_id, s + 18 + k, s + 23 + k FROM x WHERE kind = 6
        UNION ALL SELECT doc_id, s + 24 + k, s + 29 + k FROM x WHERE kind = 6 UNION ALL SELECT doc_id, s + 29 + k, s + length(seg) FROM x WHERE kind = 6""",
    "hard_citations": _S + """, x AS (SELECT *, length('p' || a) AS k FROM segs WHERE kind = 5)
        SELECT doc_id, s AS cluster, 'p' || a AS key, s + 2 AS key_start, s + 2 + k AS key_end FROM x UNION ALL SELECT doc_id, s, 'q' || b, s + 6 + k, s + 6 + k + length('q' || b) FROM x""",
    "hard_decorations": _S + """, x AS (SELECT *, length('' || a) AS k FROM segs)
        SELECT doc_id, 'addition' AS kind, s + 7 AS start, s + 8 + k AS "end" FROM x WHERE kind = 0 UNION ALL SELECT doc_id, 'comment', s + 3, s + length(seg) - 3 FROM x WHERE kind = 2
        UNION ALL SELECT doc_id, 'addition', s + 3, s + length(seg) - 3 FROM x WHERE kind = 3 UNION ALL SELECT doc_id, 'highlight:yellow', s + 5, s + 10 + k FROM x WHERE kind = 3
        UNION ALL SELECT doc_id, 'substitution_new', s + 13, s + 14 + k FROM x WHERE kind = 6 UNION ALL SELECT doc_id, 'comment', s + 35 + k, s + 38 + k FROM x WHERE kind = 6
        UNION ALL SELECT doc_id, 'addition', s + 12, s + 13 FROM x WHERE kind = 7""",
    "hard_strip": _S + """, o AS (SELECT doc_id, ord, CASE kind WHEN 0 THEN concat('```', chr(10), 'a', a, chr(10), '`````') WHEN 2 THEN '' WHEN 3 THEN concat('x ==h', a, '== y')
        WHEN 6 THEN concat('old', chr(10), chr(10), 'new~>z', a, ' t') WHEN 7 THEN concat('```', chr(10), 'open x') ELSE seg END AS x FROM segs),
        j AS (SELECT doc_id, trim(string_agg(x, chr(10) ORDER BY ord), concat(' ', chr(10))) AS out FROM o GROUP BY doc_id) SELECT doc_id, length(out) AS chars, md5(out) AS hash FROM j""",
}
QUERIES = {k: globals()[k] for k in SQL}
