"""Queries on whole documents: blocks, runs, notes, formulas, packages and previews of planted manuscripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import formula, markdown, scan
from scriptorium.sources import docx
from scriptorium.session import spread, table

DOC = """concat('# ', p_name, '\n\nSome **', p_type, '** text and {++', p_brand, '++} [@p', p_partkey, ', p. ', p_size, '] here[^n].\n\n- one ', p_size, '\n- two\n   - three\n\n```sql\nSELECT ', p_partkey, '\n```\n\n| a | b |\n| --- | --- |\n| ', p_size, ' | x |\n\n> quoted ', p_partkey, '\n\n[^n]: Note ', p_partkey, '.')"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr(DOC).alias("text"))


def _notes_off(t: str) -> str:
    return scan.footnote_definitions(t)[0]


def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.rows_from(_docs(spark, d), lambda t: markdown.block_rows(_notes_off(t)), "type string, level int, ordered boolean, language string, content string, rows int")
    return rows.select("doc_id", F.col("no").alias("block"), "type", F.col("level").cast("long").alias("level"), "language", F.col("rows").cast("long").alias("table_rows"))


def run_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.rows_from(_docs(spark, d), lambda t: markdown.run_rows(_notes_off(t)), "block int, run int, parent int, side string, type string, content string, formats string, color string, href string, attrs string")
    return rows.where("type <> 'text' OR formats <> '' OR parent IS NOT NULL").select("doc_id", F.col("block").cast("long").alias("block"), "side", "type", "content", "formats", "attrs")


def footnote_definitions(spark: SparkSession, d: str) -> DataFrame:
    return scan.rows_from(_docs(spark, d), lambda t: list(scan.footnote_definitions(t)[1].items()), "label string, note string", only_if=r"\[\^").drop("no")


def docx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    made = docx.markdown_to_docx(_docs(spark, d)).selectExpr("cast(doc_id AS string) AS path", "content")
    return docx.files_to_markdown(made).select(F.col("path").cast("long").alias("doc_id"), "text")


def preview_html(spark: SparkSession, d: str) -> DataFrame:
    return scan.text_from(_docs(spark, d), markdown.to_html, "html").select("doc_id", "html")


FORMULA = r"concat('\\frac{x_{', p_size, '}}{2}+\\sqrt{', p_partkey, '}')"


def latex_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    f = spread(table(spark, d, "part")).select("p_partkey", F.expr(FORMULA).alias("text"))
    return scan.text_from(scan.text_from(f, formula.to_omml, "text"), formula.to_latex, "latex").select("p_partkey", "latex")


def latex_tokens(spark: SparkSession, d: str) -> DataFrame:
    f = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr(FORMULA).alias("text"))
    t = scan.rows_from(f, formula.tokens, "type string, value string, pos long")
    return t.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


def latex_wrap(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "part")).select("p_partkey", F.expr(r"concat('a\n\\begin{align}\nx&=', p_size, '\n\n\\end{align}\nb `\\begin{align}y\\end{align}`')").alias("text"))
    return scan.text_from(t, scan.wrap_environments, "out").select("p_partkey", "out")


def cell_runs(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr("concat('<b>', p_name, '</b> &amp; <i>x<sup>', p_size, '</sup></i><br><a href=\"u', p_partkey, '\">l</a>')").alias("text"))
    return scan.rows_from(t, lambda s: scan.merge_runs(scan.cell_runs(s)), "content string, formats string, href string")


def html_table_cells(spark: SparkSession, d: str) -> DataFrame:
    def cells(t: str):
        return [(n, len(b.rows[n]), sum(c[1] for c in b.rows[n])) for b in markdown.blocks(t) if b.type == "table" for n in range(len(b.rows))]

    t = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr("concat('<table><tr><td colspan=\"', p_size % 3 + 1, '\">a</td><td>b</td></tr><tr><th>c</th></tr></table>')").alias("text"))
    return scan.rows_from(t, cells, "row long, cells long, columns long").drop("no")


def paragraph_safe(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "part")).select("p_partkey", F.expr("concat('a\n\n{++x', p_size, '\n\ny++} b\n\n{>>c\n\nd<<}')").alias("text"))
    return scan.text_from(t, scan.hold_paragraphs, "out").select("p_partkey", F.regexp_count("out", F.lit(scan.BREAK)).cast("long").alias("held"), F.regexp_count("out", F.lit("\n\n")).cast("long").alias("left"))


def matched_comments(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("doc_id"), F.expr("concat('{>>a {>>b', p_size, '<<} c<<} {>>open {>>d<<}')").alias("text"))
    return scan.rows_from(t, lambda s: sorted(scan.closes(s).items()), "start long, end long").drop("no")


_N = "length(CAST(p_size AS VARCHAR))"
SQL = {
    "block_kinds": """WITH b AS (SELECT * FROM (VALUES (0, 'heading', 1, NULL, 0), (1, 'paragraph', 0, NULL, 0), (2, 'list_item', 0, NULL, 0), (3, 'list_item', 0, NULL, 0), (4, 'list_item', 1, NULL, 0), (5, 'code', 0, 'sql', 0), (6, 'table', 0, NULL, 2), (7, 'quote', 1, NULL, 0)) t(block, type, level, language, table_rows))
        SELECT p_partkey AS doc_id, block, type, level, language, table_rows FROM part, b""",
    "run_kinds": """SELECT p_partkey AS doc_id, 1 AS block, '' AS side, 'text' AS type, p_type AS content, 'bold' AS formats, '' AS attrs FROM part
        UNION ALL SELECT p_partkey, 1, '', 'addition', p_brand, '', '' FROM part UNION ALL SELECT p_partkey, 1, 'inner', 'text', p_brand, '', '' FROM part
        UNION ALL SELECT p_partkey, 1, '', 'citation', '@p' || p_partkey || ', p. ' || p_size, '', 'keys=p' || p_partkey || ';locators=p. ' || p_size FROM part
        UNION ALL SELECT p_partkey, 1, '', 'note', '', '', 'label=n' FROM part""",
    "footnote_definitions": "SELECT p_partkey AS doc_id, 'n' AS label, 'Note ' || p_partkey || '.' AS note FROM part",
    "docx_roundtrip": """SELECT p_partkey AS doc_id, concat('# ', p_name, chr(10), chr(10), 'Some **', p_type, '** text and ', p_brand, ' (@p', p_partkey, ') here[^n].', chr(10), chr(10), '- one ', p_size, chr(10), '- two', chr(10), '   - three', chr(10), chr(10),
        '```sql', chr(10), 'SELECT ', p_partkey, chr(10), '```', chr(10), chr(10), '| a | b |', chr(10), '| --- | --- |', chr(10), '| ', p_size, ' | x |', chr(10), chr(10), '> quoted ', p_partkey, chr(10), chr(10), 'Citation data for @p', p_partkey, ' was not found in the bibliography file.', chr(10), chr(10), '[^n]: Note ', p_partkey, '.', chr(10)) AS text FROM part""",
    "preview_html": """SELECT p_partkey AS doc_id, array_to_string(['<h1>' || p_name || '</h1>', concat('<p>Some <strong>', p_type, '</strong> text and <ins>', p_brand, '</ins> <span class="citation">[@p', p_partkey, ', p. ', p_size, ']</span> here<sup class="note">n</sup>.</p>'),
        '<ul>', '<li>one ' || p_size, '</li>', '<li>two', '<ul>', '<li>three', '</li></ul>', '</li></ul>', '<pre><code class="language-sql">SELECT ' || p_partkey || '</code></pre>',
        '<table><tr><th>a</th><th>b</th></tr><tr><td>' || p_size || '</td><td>x</td></tr></table>', '<blockquote>quoted ' || p_partkey || '</blockquote>', '<p class="note" id="n">Note ' || p_partkey || '.</p>'], chr(10)) AS html FROM part""",
    "latex_roundtrip": "SELECT p_partkey, concat('\\frac{x_{', p_size, '}}{2}+\\sqrt{', p_partkey, '}') AS latex FROM part",
    "latex_tokens": f"""WITH x AS (SELECT p_partkey, {_N} AS a, length(CAST(p_partkey AS VARCHAR)) AS b FROM part)
        SELECT p_partkey AS doc_id, 'command' AS type, 2 AS n, 15 + a AS last FROM x UNION ALL SELECT p_partkey, 'open', 4, 20 + a FROM x UNION ALL SELECT p_partkey, 'close', 4, 21 + a + b FROM x
        UNION ALL SELECT p_partkey, 'down', 1, 7 FROM x UNION ALL SELECT p_partkey, 'char', 3 + a + b, 20 + a + b FROM x""",
    "latex_wrap": r"""SELECT p_partkey, concat('a', chr(10), '$$', chr(10), '\begin{align}', chr(10), 'x&=', p_size, chr(10), '\end{align}', chr(10), '$$', chr(10), 'b `\begin{align}y\end{align}`') AS out FROM part""",
    "cell_runs": """SELECT p_partkey AS doc_id, "no", content, formats, href FROM part, LATERAL (VALUES (0, p_name, 'bold', NULL), (1, ' & ', '', NULL), (2, 'x', 'italic', NULL), (3, CAST(p_size AS VARCHAR), 'italic+superscript', NULL), (4, chr(10), '', NULL), (5, 'l', '', 'u' || p_partkey)) t("no", content, formats, href)""",
    "html_table_cells": 'SELECT p_partkey AS doc_id, 0 AS "row", 2 AS cells, p_size % 3 + 2 AS columns FROM part UNION ALL SELECT p_partkey, 1, 1, 1 FROM part',
    "paragraph_safe": 'SELECT p_partkey, 2 AS held, 2 AS "left" FROM part',
    "matched_comments": f"""SELECT p_partkey AS doc_id, 3 AS start, 14 + {_N} AS "end" FROM part UNION ALL SELECT p_partkey, 8, 9 + {_N} FROM part UNION ALL SELECT p_partkey, 29 + {_N}, 30 + {_N} FROM part""",
}
QUERIES = {k: globals()[k] for k in SQL}
