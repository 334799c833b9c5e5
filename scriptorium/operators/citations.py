"""Citations and bibliographies of documents in the styles that they name."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.styles import STYLES, Style
from scriptorium.session import dealt, ship

MAX_STYLES = 1_000


def style_table(df: DataFrame | None) -> dict[str, str]:
    """Trees by name, those of the library and those of ``df`` (``style, tree``), which may replace them."""
    if df is None:
        return dict(STYLES)
    rows = df.select("style", "tree").limit(MAX_STYLES + 1).collect()
    if len(rows) > MAX_STYLES:
        raise ValueError(f"more than {MAX_STYLES} styles are too many to send to the documents")
    return STYLES | {r.style: r.tree for r in rows}


def rendered(cites: DataFrame, items: DataFrame, styles: DataFrame | None = None, default: str = "author-date") -> DataFrame:
    """``doc_id, kind, place, key, text``: the citations (``kind`` citation, at the place of their cluster) and the entries of each document.

    ``cites`` has ``doc_id, cluster, ord, key, locator, style``: keys in order, clusters by where they stand; ``items`` has ``key, item`` (JSON), or
    ``doc_id, key, item`` if documents have bibliographies of their own. A style that is not known is ``default``. A document's
    cites meet in one task, which is what telling its works apart needs; documents are dealt out by identifier.
    """
    ship(cites.sparkSession)
    trees = style_table(styles)
    on = ["doc_id", "key"] if "doc_id" in items.columns else ["key"]
    rows = cites.join(items.select(*on, "item").dropDuplicates(on), on, "left").select("doc_id", "cluster", "ord", "key", "locator", F.when(F.col("style").isin(*trees), F.col("style")).otherwise(F.lit(default)).alias("style"), "item")
    kind = dict(cites.dtypes)["doc_id"]

    def one(doc: list[tuple], made: dict[str, Style]) -> Iterator[tuple]:
        places, clusters, known = [], [], {}
        for _, cluster, _, key, locator, _, item in doc:
            if not places or places[-1] != cluster:
                places.append(cluster)
                clusters.append([])
            clusters[-1].append((key, locator))
            if item is not None:
                known[key] = json.loads(item)
        name = doc[0][5]
        if name not in made:
            made[name] = Style(trees[name])
        out = made[name].document(clusters, known)
        yield from ((doc[0][0], "citation", p, None, t) for p, t in zip(places, out.clusters))
        yield from ((doc[0][0], "entry", n, k, t) for n, (k, t) in enumerate(out.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Style] = {}
        held: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != r[0]:
                    out += one(held, made)
                    held = []
                held.append(r)
            yield _batch(out, b.schema.field(0).type)
        if held:
            yield _batch(list(one(held, made)), b.schema.field(0).type)

    return dealt(rows, ["doc_id"], ["cluster", "ord"]).mapInArrow(run, f"doc_id {kind}, kind string, place long, key string, text string")


def _batch(rows: list[tuple], first: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    types = (first, pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "kind", "place", "key", "text"])
