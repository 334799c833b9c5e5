"""Streams of edits: bursts, latest versions, and checks against a bibliography that changes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Silence in milliseconds after which an editor's features run.
DEBOUNCE_MS = {"validation": 300, "word_count": 500, "decorations": 150}


def bursts(edits: DataFrame, key: str = "doc_id", ts: str = "ts", gap: str = "300 milliseconds", late: str = "10 seconds", order: list[str] | None = None) -> DataFrame:
    """The last edit of each burst and the number of edits in it; a burst ends with ``gap`` of silence.

    On a stream, a burst comes out once the watermark has passed its end; later edits than ``late`` are
    dropped. A batch gives the same bursts. Of edits of one time the last by ``order`` counts.
    """
    rows = edits.withWatermark(ts, late) if edits.isStreaming else edits
    rest = F.struct(*[c for c in edits.columns if c not in (key, ts)])
    g = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max_by(rest, F.struct(ts, *(order or []))).alias("last"), F.max(ts).alias("at"), F.count("*").alias("edits"))
    return g.select(key, "at", "edits", "last.*")


def newest(edits: DataFrame, key: str = "doc_id", version: str = "version", timeout_ms: int | None = None) -> DataFrame:
    """Edits that are newer than any seen of their document: one number of state per document.

    It is kept for good, so that an old version never passes; with ``timeout_ms`` it is given up after as long without an edit. ``edits`` has ``key`` (long), ``version`` (long) and ``text``; within a micro-batch the newest stays.
    """

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else -1
        best = None
        for b in batches:
            top = b.loc[b[version].idxmax()]
            if top[version] > seen:
                seen, best = int(top[version]), top
        state.update((seen,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        if best is not None:
            yield pd.DataFrame({key: [k[0]], version: [seen], "text": [best["text"]]})

    return edits.select(key, version, "text").groupBy(key).applyInPandasWithState(step, f"{key} long, {version} long, text string", "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def check_keys(edits: DataFrame, bibliography: DataFrame, key: str = "doc_id") -> DataFrame:
    """Citation keys of edits that the bibliography lacks; a stream joins the table as it is in each micro-batch."""
    keys = edits.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("@([A-Za-z0-9_:-]+)"), F.lit(1)))).alias("cited"))
    known = bibliography.select(F.col("key").alias("cited"), F.lit(True).alias("known"))
    return keys.join(known, "cited", "left").where("known IS NULL").select(key, "cited")


def watch_text(spark, folder: str, pattern: str = "*.md") -> DataFrame:
    """New files of a folder as a stream of ``path, text``; ``sources.watched`` also sees files that change or go."""
    return spark.readStream.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
