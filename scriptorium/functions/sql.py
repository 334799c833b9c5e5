"""The scanners as SQL functions: ``register(spark)`` and then ``SELECT strip_marks(text)`` or ``LATERAL``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import formula, markdown, scan
from scriptorium.session import ship

SCALAR = {"strip_marks": scan.strip_marks, "mask_delimiters": scan.mask_delimiters, "hold_paragraphs": scan.hold_paragraphs, "wrap_environments": scan.wrap_environments, "latex_to_omml": formula.to_omml, "omml_to_latex": formula.to_latex, "preview_html": markdown.to_html, "escape_latex": formula.escape_latex}
TABLES = {
    "code_regions": (scan.code_regions, "start long, end long"),
    "inert_zones": (scan.inert_zones, "start long, end long"),
    "citation_key_ranges": (scan.key_ranges, "start long, end long, key string"),
    "comment_ranges": (scan.comment_ranges, "start long, end long, id string, about string"),
    "latex_tokens": (formula.tokens, "type string, value string, pos long"),
    "markdown_blocks": (markdown.block_rows, "type string, level int, ordered boolean, language string, content string, rows int"),
    "markdown_runs": (markdown.run_rows, "block int, run int, parent int, side string, type string, content string, formats string, color string, href string, attrs string"),
    "bib_entries": (lambda t: [(k, e, at) for k, e, _, at in scan.parse_bib(t)], "type string, entry string, at long"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all; the names are returned."""
    ship(spark)
    for name, f in SCALAR.items():

        def run(c: pa.Array, f=f) -> pa.Array:
            return pa.array([None if t is None else f(t) for t in c.to_pylist()], pa.string())

        run.__annotations__ = {"c": pa.Array, "return": pa.Array}
        spark.udf.register(name, F.arrow_udf(lambda c, run=run: run(c), "string"))
    for name, (f, schema) in TABLES.items():

        class Table:
            def eval(self, text: str, f=f):
                yield from f(text) if text is not None else ()

        spark.udtf.register(name, F.udtf(Table, returnType=schema))
    return [*SCALAR, *TABLES]
