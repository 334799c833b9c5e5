"""Debouncing by timers: what an editor runs after a moment of silence, for each document by itself.

Each document has one state: the newest edit, how many edits there were since anything ran, and of each
feature the version that it last ran for. An edit that is newer than all seen replaces the one that waits and
starts the silence anew; older and repeated versions count as stale and start nothing. When a feature's silence has passed,
it runs once, for the newest version. The clock is the engine's processing time, so nothing waits for
other documents' edits or a watermark; a timer fires in the first micro-batch after its time.

A state without edits for ``forget`` is removed if that is given; then a version as old as any counts as
new. Without it a document's state (one text at most, while it waits) is kept for good, so that an old version never comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.session import ship
from scriptorium.streaming.edits import DEBOUNCE_MS

STATE = "version long, text string, edits long, stale long, last_ms long"


class Debounce(StatefulProcessor):
    """Rows ``doc_id, version, text`` to ``doc_id, feature, version, text, edits, stale, due_ms``."""

    def __init__(self, gaps: dict[str, int], forget_ms: int | None = None) -> None:
        self.gaps, self.forget_ms = dict(gaps), forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)
        self.ran = handle.getMapState("ran", "feature string", "version long")

    def _timers(self, last_ms: int) -> set[int]:
        return {last_ms + g for g in [*self.gaps.values(), *([self.forget_ms] if self.forget_ms else [])]}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        had = self.newest.get() if self.newest.exists() else None
        version, text, edits, stale, last = had if had is not None else (None, None, 0, 0, 0)
        fresh = False
        for r in rows:
            if r.version is not None and (version is None or r.version > version):
                version, text, edits, fresh = r.version, r.text, edits + 1, True
            else:
                stale += 1
        if fresh:
            if had is not None:
                for t in self._timers(last):
                    self.handle.deleteTimer(t)
            for t in self._timers(now):
                self.handle.registerTimer(t)
            last = now
        if version is not None:
            self.newest.update((version, text, edits, stale, last))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.newest.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        version, text, edits, stale, last = self.newest.get()
        waiting = False
        for feature, gap in self.gaps.items():
            ran = self.ran.getValue((feature,)) if self.ran.containsKey((feature,)) else None
            if ran is not None and ran[0] >= version:
                continue
            if last + gap <= at:
                self.ran.updateValue((feature,), (version,))
                yield Row(doc_id=key[0], feature=feature, version=version, text=text, edits=edits, stale=stale, due_ms=last + gap)
            else:
                waiting = True
        if self.forget_ms and last + self.forget_ms <= at and not waiting:
            self.newest.clear()
            self.ran.clear()
        elif not waiting:
            self.newest.update((version, None, 0, 0, last))  # the text has been given out

    def close(self) -> None:
        pass


def debounced(edits: DataFrame, gaps: dict[str, int] | None = None, forget_ms: int | None = None) -> DataFrame:
    """Of a stream ``doc_id (long), version (long), text``: a row whenever a feature shall run for a document.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ship(edits.sparkSession)
    rows = edits.select("doc_id", "version", "text").groupBy("doc_id")
    schema = "doc_id long, feature string, version long, text string, edits long, stale long, due_ms long"
    return rows.transformWithState(Debounce(gaps or DEBOUNCE_MS, forget_ms), schema, "Append", "ProcessingTime")
