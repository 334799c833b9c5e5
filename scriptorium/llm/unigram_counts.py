"""Token counts under a unigram vocabulary, by a Viterbi search that keeps only score and count.

The text becomes what the vocabulary speaks of: spaces turn into U+2581 and one more stands before the
text. An Aho-Corasick automaton enumerates every vocabulary entry at every place in one pass; dynamic
programming over end positions carries the best score and the number of pieces on the way to it, and
no path. Ties are settled as the tokenizer settles them: of equal scores at a position, the piece that
begins first, the longest, stays. Where no entry of one character begins, the unknown piece covers that
character at the lowest score of the vocabulary less ten, and counts as its UTF-8 bytes if the
vocabulary falls back on bytes, or else as one for each run of unknown characters.

The vocabulary given by default, ``piece_bpe_32k.model``, was made for merging by rank: its scores are
ranks with a minus sign. Here it is read as what the method needs, a unigram vocabulary, so counts are
those of a unigram tokenizer with these pieces and scores (the ``tokenizers`` library's ``Unigram`` gives the
same for every text tried), and not those of the file's own tokenizer, which has 12 % fewer pieces
on the driver's documents.

No entry has U+2581 after another character (this is checked when the vocabulary is loaded), so every
way through a text passes each place where U+2581 follows another character; scores there are sums of
doubles, exact for whole-numbered scores, so parts between such places are searched alone, and distinct
parts only once in each worker, within bounds.

Null texts count as empty, which have no pieces and score 0; empty tables give empty results; a text of
any length is searched in time that grows with it. Repeated rows give repeated rows; null
identifiers pass through; other columns are not read. The vocabulary is read on the driver and
broadcast, its size checked.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of
from .pieces import Memo, slices

MAX_VOCABULARY_BYTES = 64_000_000
SPACE = "▁"
#: Fixed values of the model file's piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type of each entry of a model file."""
    out = []
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            out.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
    return out


class UnigramCounter:
    """Counts pieces of best paths."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]) -> None:
        self.bytes = any(t == BYTE for _, _, t in vocabulary)
        self.auto = ahocorasick.Automaton()
        used = [(p, s) for p, s, t in vocabulary if t in (NORMAL, USER_DEFINED) and p]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in used):
            raise ValueError("an entry has a space after another character; parts of texts can't be searched alone")
        for p, s in used:
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unknown = min((s for _, s, t in vocabulary if t in (NORMAL, USER_DEFINED, UNKNOWN)), default=0.0) - 10.0
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]*")
        self.memo = Memo(lambda parts: map(self.search, parts))

    def search(self, part: str) -> tuple[int, float, bool, bool]:
        """Pieces and score of the best path; whether it begins and ends with an unknown character."""
        n = len(part)
        if not n:
            return 0, 0.0, False, False
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        lost = [False] * (n + 1)  # whether the last piece is unknown
        first = [False] * (n + 1)
        at = 0
        for end, (size, score) in self.auto.iter(part):
            end += 1
            while at < end - 1:  # positions that no entry ends at, or whose entries are done
                at += 1
                self._close(part, at, best, count, lost, first)
            begin = end - size
            before = best[begin] if begin else 0.0
            s = before + score
            if best[end] is None or s > best[end]:
                best[end], count[end], lost[end] = s, count[begin] + 1, False
                first[end] = first[begin] if begin else False
            if size == 1:
                self._single = end
        while at < n:
            at += 1
            self._close(part, at, best, count, lost, first)
        self._single = -1
        return count[n], best[n], first[n], lost[n]

    _single = -1

    def _close(self, part: str, end: int, best: list, count: list, lost: list, first: list) -> None:
        """Offer the unknown piece for the character before ``end`` if no entry is that character."""
        if self._single == end:
            return
        s = best[end - 1] + self.unknown
        if best[end] is None or s > best[end]:
            c = part[end - 1]
            size = len(c.encode("utf-8", "surrogatepass")) if self.bytes else 0 if lost[end - 1] else 1
            best[end], count[end], lost[end] = s, count[end - 1] + size, True
            first[end] = first[end - 1] if end > 1 else True

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        found = [self.parts.findall(SPACE + t.replace(" ", SPACE))[:-1] if t else [] for t in texts]
        known = self.memo.learn(set().union(*found)).__getitem__
        out = []
        for f in found:
            got = list(map(known, f))
            n, score = sum([g[0] for g in got]), sum([g[1] for g in got])
            if not self.bytes:  # a run of unknown characters that goes on into the next part
                n -= sum(a[3] and b[2] for a, b in zip(got, got[1:]))
            out.append((n, score))
        return out


_made: dict[bytes, UnigramCounter] = {}


def _counter(model: bytes) -> UnigramCounter:
    key = hashlib.sha256(model).digest()
    if key not in _made:
        _made.clear()
        _made[key] = UnigramCounter(read_model(model))
    return _made[key]


def count_tokens(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` of each row."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    if len(model) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {len(model)} bytes is too large to broadcast")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                got = counter.count(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")
