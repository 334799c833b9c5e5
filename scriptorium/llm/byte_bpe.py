"""Byte-level BPE by ranks: encoding with the ``tokenizers`` library over Arrow batches, and decoding.

Bytes are mapped to printable characters (the usual table: printable Latin-1 characters stand for
themselves, the others move up from U+0100), so that a rank file becomes a vocabulary of strings for
the library. Ranks say which merges there are: any two tokens whose bytes together are a token, the
lower the rank of the result the earlier. A match of the pattern that is a token as a whole is that
token. The library orders merges by pair, ranks order them by result; the two can differ where a
result can be had from two pairs and occurs twice in a match. Such a token has three bytes at least, so
a match without a repeated run of three bytes is safe; the ids of any other distinct match are checked
against merging by rank, and it takes the ids of the latter.

Texts are cut before every space that a non-space follows and between a word and a sign that ends it,
which are always boundaries of the pattern's matches; distinct cuts, found by Arrow, are encoded once and remembered in each worker within
bounds. A text of any length is one row; one without spaces is one cut.
Decoding goes back from characters to bytes by the reversed table; a character whose bytes lie in two
tokens comes out whole where tokens are joined before bytes become text, and a text of ids that ends
within a character is decoded with U+FFFD for it.

Null texts count as empty; empty texts have no ids. White space is Unicode's White_Space. Repeated
rows give repeated rows; null identifiers pass through; other columns are not read. The rank file is
read on the driver and broadcast; its size is checked against ``MAX_VOCABULARY_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, ship, text_of
from .pieces import WHITE, Memo, by_word, byte_slices

MAX_VOCABULARY_BYTES = 64_000_000


def byte_chars() -> list[str]:
    """The character of each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, up = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else up))
        up += b not in plain
    return out


def _repeating(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Which of the pieces that end at ``ends`` have a run of three bytes twice."""
    if len(raw) < 4:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    runs = (piece[:-2] << 24 | b[:-2] << 16 | b[1:-1] << 8 | b[2:])[piece[:-2] == piece[2:]]
    runs.sort()
    return np.unique(runs[1:][runs[1:] == runs[:-1]] >> 24)


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.chars = byte_chars()
        self.latin = dict(enumerate(self.chars))
        self.to_byte = {c: b for b, c in enumerate(self.chars)}
        shown = {t: self._shown(t) for t in self.ranks}
        merges = [(shown[t[:k]], shown[t[k:]]) for t in sorted(self.ranks, key=self.ranks.get) for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.tokenizer = Tokenizer(BPE({shown[t]: r for t, r in self.ranks.items()}, merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = WhitespaceSplit()  # byte characters are no white space
        self.table: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.table[r] = bytes(self.to_byte[c] for c in shown[t])
        self.sizes = np.array([len(t) for t in self.table])
        white = f"[{WHITE}]"
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", white))
        self.cut = regex.compile(f" (?=[^{WHITE}])")
        self.gap = re.compile(r" \s")
        self.memo = Memo(self._cuts, limit=250_000)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one match, merging by rank, leftmost first among equals."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, ranks, n_ranks = len(piece), self.ranks, len(self.table)
        if n <= 32:
            parts = [piece[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                least, at = min([(ranks.get(a + b, n_ranks), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))])
                if least == n_ranks:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        end, left = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i] if i < n else n
            if not alive[i] or j >= n or not alive[j] or end[j] != e:
                continue
            alive[j], end[i] = False, e
            if e < n:
                left[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (h := left[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _shown(self, piece: bytes) -> str:
        return piece.decode("latin-1").translate(self.latin)

    def _matches(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; tokens of all of them come in one list, and their bytes tell where a piece ends."""
        if not pieces:
            return []
        made = pa.array(pieces, pa.string())
        ends = np.frombuffer(made.buffers()[1], np.int32)[1 : len(pieces) + 1].astype(np.int64)
        raw = made.buffers()[2].to_pybytes()[: ends[-1]]
        shown, bounds = self._shown(raw), [0, *ends.tolist()]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([shown[a:b] for a, b in zip(bounds, bounds[1:])])], add_special_tokens=False)[0].ids, "<u4")
        last = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        coded, cuts = ids.tobytes(), [0, *(4 * last).tolist()]
        out = [coded[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.intersect1d(_repeating(raw, ends), np.flatnonzero(np.diff(last, prepend=0) > 1)).tolist():
            out[i] = np.array(self.merged(raw[bounds[i] : bounds[i + 1]]), "<u4").tobytes()
        return out

    def _cuts(self, cuts: list[str]) -> list[bytes]:
        """Words of letters, with or without a space before them, and single signs are matches of the pattern;
        it finds those of others."""
        simple = pc.match_substring_regex(pa.array(cuts, pa.string()), "^(?: ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?])$").to_pylist()
        found = [(c,) if x else self.pattern.findall(c) for c, x in zip(cuts, simple)]
        parts = list(set(chain.from_iterable(found)))
        known = dict(zip(parts, self._matches(parts))).__getitem__
        return [known(f[0]) if len(f) == 1 else b"".join(map(known, f)) for f in found]

    def cuts_of(self, text: str) -> list[str]:
        """Parts of ``text``, each but the first with the space before it."""
        if "\0" in text:
            return [text]
        if text[-1:] == " " or self.gap.search(text):
            return self.cut.sub("\0 ", text).split("\0")
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers.

        Cuts stand before spaces, and between a word and a sign that ends it. Texts in which white space
        follows a space are cut one by one.
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        cut = pc.replace_substring(texts, " ", "\0 ")
        cut = pc.replace_substring_regex(cut, "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])(\0|$)", "\\1\0\\2\\3")
        odd = pc.or_(pc.match_substring(texts, "\0"), pc.match_substring_regex(texts, f" (?:[{WHITE}]|$)"))
        lists = pc.split_pattern(cut, "\0")
        ends, ids = by_word(lists.flatten(), self.memo.learn)
        raw, cuts = ids.tobytes(), (4 * ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]).tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i in alone:
            parts = self.cuts_of(texts[i].as_py())
            out[i] = b"".join(map(self.memo.learn(set(parts)).__getitem__, parts))
        return out

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The bytes of ids."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, ids: bytes | np.ndarray) -> list[tuple[int, int]]:
        """Of each id the characters of the text that have bytes in it, first and one past the last."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        raw = np.frombuffer(self.decode(ids), np.uint8)
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
        end = np.cumsum([len(self.table[i]) for i in ids.tolist()], dtype=np.int64)
        begin = np.concatenate([[0], end[:-1]]) if len(end) else end
        inside = np.array([b < len(raw) and (raw[b] & 0xC0) == 0x80 for b in begin.tolist()], bool)
        return [(int(starts[b]) - int(i), int(starts[e])) for b, e, i in zip(begin.tolist(), end.tolist(), inside)]


_made: dict[tuple, ByteBPE] = {}


def _bpe(rank_file: bytes, pattern: str) -> ByteBPE:
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(rank_file, pattern)
    return _made[key]


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids (binary), ids_sha256, decoded_sha256`` of each row.

    ``ids`` are little-endian unsigned 32-bit integers (left out if ``ids`` is false). The decoded
    bytes are made from the ids, not from the text.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        rank_file = f.read()
    if len(rank_file) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a rank file of {len(rank_file)} bytes is too large to broadcast")
    sent = spark.sparkContext.broadcast(rank_file)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value, pattern)
        for b in batches:
            for lo, hi in byte_slices(b.column(1), 4_000_000):
                coded = bpe.encode(b.column(1).slice(lo, hi - lo))
                cols = [b.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in coded], pa.int64())]
                cols += [pa.array(coded, pa.binary())] if ids else []
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded])]
                yield pa.RecordBatch.from_arrays(cols, names)
        bpe = None
        _made.clear()  # a worker keeps no cuts for other operators to carry

    names = ["doc_id", "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]
    schema = "doc_id long, n_tokens long, " + "ids binary, " * ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(coded: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are not UTF-8 become U+FFFD."""
    spark = coded.sparkSession
    ship(spark)
    with open(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value, pattern)
        for b in batches:
            texts = [bpe.decode(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
