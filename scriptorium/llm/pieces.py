"""What the tokenizing operators share: work on distinct pieces of text, remembered for a while."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

V = TypeVar("V")

#: White space as Unicode's property White_Space has it (Python's ``isspace`` also has U+001C to U+001F).
WHITE = "\t-\r \x85\xa0  -     　"


class Memo(Generic[V]):
    """Results by piece. ``make`` computes those of distinct pieces that are not yet known.

    It holds ``limit`` pieces of up to ``longest`` characters at most; when it is full, pieces that
    were not met again since the last time go. Longer pieces are forgotten after the batch. None of
    this changes a result.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[V]], limit: int = 300_000, longest: int = 64) -> None:
        self.make, self.limit, self.longest = make, limit, longest
        self.known: dict[str, V] = {}
        self.again: set[str] = set()
        self.long: list[str] = []

    def learn(self, pieces: set[str]) -> dict[str, V]:
        """A dictionary that has all ``pieces``, good until the next call."""
        for k in self.long:
            del self.known[k]
        if len(self.known) + len(pieces) > self.limit:
            self.known = {k: self.known[k] for k in self.again} if 2 * len(self.again) < self.limit else {}
            self.again = set()
        known = self.known
        new = list(pieces - known.keys())
        if 2 * len(known) > self.limit:
            self.again |= pieces
            self.again.difference_update(new)
        known.update(zip(new, self.make(new)))
        self.long = [k for k in new if len(k) > self.longest]
        return known


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters each, one text at least."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def byte_slices(texts: pa.Array, size: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` bytes each, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


def gathered(each: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that ``codes`` name in order, and where each word's end (0 before all); ``each`` has ids as little-endian 32-bit integers."""
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    table = np.frombuffer(b"".join(each), "<u4")
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    shift = (np.cumsum(size) - size)[codes] - ends[:-1]
    return ends, table[np.arange(ends[-1]) + np.repeat(shift, n)] if len(table) else table


def by_word(words: pa.Array, learn: Callable[[set[str]], dict[str, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """``gathered`` for words, of which ``learn`` is asked each distinct one."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    known = learn(set(distinct))
    return gathered(list(map(known.__getitem__, distinct)), coded.indices.to_numpy())
