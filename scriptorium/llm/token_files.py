"""Token ids in binary files: tokenizing, Simple-8b word-aligned coding, and reading back.

A file is a run of whole documents in ascending order of identifier (null first, equal identifiers by
a hash of their texts)::

    magic  8 bytes   "S8BTOK01"
    header 5 x u64   order (partition << 32 | number in it), documents, ids, blocks, words
    ids    documents x i64     identifiers; present  documents x u8 (0: null identifier)
    counts documents x u64     ids of each document, the end id included
    blocks (blocks + 1) x u64  index of each block's first word, and the number of words
    words  words x u64
    newline, which ends the file

A block is ``BLOCK`` ids (the last one fewer), counted through the file across documents, so one
block can be decoded without the others. A word has a selector in its upper 4 bits and in the lower 60
as many ids of one width as the selector says, the first in the lowest bits; words end with blocks.
Selector 0 is the escape: the id, which is wider than 60
bits, is the next word as it is. Decoding treats all words with the same selector at once.

The library encodes the distinct words of a batch, found by Arrow, and those are remembered in each
worker within bounds; ids of texts are gathered from them. Strings of special tokens in a text are
ordinary text. A text of any length is one document; a text without white space is one word, which
the library sees whole. Null texts count as empty and have only the end id. Repeated rows appear as often.
Empty tables give no files and an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_chars
from .common import blobs_in, blobs_out, cut, released, remove, ship, text_of, work_dir
from .pieces import Memo, by_word, byte_slices

MAGIC = b"S8BTOK01"
BLOCK = 4096
MAX_VOCABULARY_BYTES = 64_000_000

#: Fixed values of the format: of each selector, ids in a word and bits of each.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of unsigned 64-bit integers, and the index of each block's first word (and their number)."""
    v = np.asarray(values)
    v = v if v.dtype == np.uint32 else v.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    step, selector = np.ones(n, np.int8), np.zeros(n, np.int8)
    ends = np.append(np.arange(block, n, block), n)
    widest = int(v.max()).bit_length()
    for s in range(15, 0, -1):  # ever more ids a word
        c, b = int(COUNTS[s]), int(BITS[s])
        if widest <= b:
            late = (ends[:, None] - np.arange(1, c)).ravel() if c > 1 else np.zeros(0, np.int64)
            late = late[late >= 0]
            was = step[late], selector[late]
            step[:], selector[:] = c, s
            step[late], selector[late] = was
            continue
        walls = np.flatnonzero(v >= (1 << b))
        walls = np.concatenate([[-1], walls, [n]])
        long = np.flatnonzero(np.diff(walls) > c)  # runs of c narrow ids at least
        if not len(long):
            break
        room = walls[long + 1] - walls[long] - c
        fits = np.repeat(walls[long] + 1, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        fits = fits[fits + c <= np.minimum((fits // block + 1) * block, n)]
        selector[fits], step[fits] = s, c
    v = v.astype(np.uint64)
    starts, hop = [], step.tolist()
    for lo in range(0, n, block):
        i, hi = lo, min(lo + block, n)
        while i < hi:
            starts.append(i)
            i += hop[i]
    starts = np.array(starts)
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen[chosen > 0]).tolist():
        w = np.flatnonzero(chosen == s)
        first = starts[w]
        for k in range(int(COUNTS[s])):
            words[w] |= v[first + k] << np.uint64(k * int(BITS[s]))
    escapes = np.flatnonzero(chosen == 0)
    first_of = np.searchsorted(starts, np.arange(0, n, block))
    index = np.append(first_of + np.searchsorted(escapes, first_of), len(words) + len(escapes))
    return (np.insert(words, escapes + 1, v[starts[escapes]]) if len(escapes) else words), index


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """``n`` values of the words of one block, or of neighbouring blocks."""
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():  # in order: a raw word isn't a selector
        if not raw[i]:
            raw[i + 1] = True
    head = np.flatnonzero(~raw)
    counts = COUNTS[selector[head]]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros(int(counts.sum()) if len(head) else 0, np.uint64)
    for s in np.unique(selector[head]).tolist():
        w = np.flatnonzero(selector[head] == s)
        if s == 0:
            out[first[w]] = words[head[w] + 1]
            continue
        at, some, mask = first[w], words[head[w]], np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[at + k] = (some >> np.uint64(k * int(BITS[s]))) & mask
    return out[:n]


def pack_file(order: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file, without the newline."""
    words, index = pack(ids)
    return b"".join(
        [
            MAGIC,
            struct.pack("<5Q", order, len(doc_ids), len(ids), len(index) - 1, len(words)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            bytes(d is not None for d in doc_ids),
            np.array(counts, "<u8").tobytes(),
            index.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def read_file(data: bytes, blocks: range | None = None) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """Order, identifiers, counts, and the ids of all blocks or of those asked for."""
    if data[:8] != MAGIC:
        raise ValueError("this is not a file of token ids")
    order, docs, ids, n_blocks, n_words = struct.unpack_from("<5Q", data, 8)
    at = 48
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    there = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(data, "<u8", docs, at := at + docs)
    index = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at := at + 8 * (n_blocks + 1))
    if blocks is None:
        got = unpack(words, ids)
    else:
        got = np.concatenate([np.zeros(0, np.uint64), *(unpack(words[index[i] : index[i + 1]], min(BLOCK, ids - i * BLOCK)) for i in blocks)])
    return order, [int(d) if t else None for d, t in zip(doc_ids, there)], counts.astype(np.int64), got


class WordIds:
    """Ids of texts by the ``tokenizers`` library, distinct words only once.

    Words are what ASCII white space parts, and runs of ``.,;:!?`` after a letter or digit are words of
    their own: the pattern's matches end there, and neither normalising nor lower-casing goes across.
    Letters are limited to those that stay one letter through both (U+0130 does not).
    """

    def __init__(self, model: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(model)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # The same model for matches of the pattern that are normalised, in the library's byte characters.
        self.bare = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        chars = byte_chars()
        self.shown = {ord(c): "".join(chars[x] for x in c.encode()) for c in map(chr, [0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100)])}
        self.memo = Memo(self._words, limit=900_000)
        self.plain = re.compile("[a-zß-öø-ÿ]+|[.,;:!?]+").fullmatch  # one match of the pattern, and normalised
        self.signs = re.compile("[!-@[-~]+").fullmatch
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _words(self, words: list[str]) -> list[bytes]:
        """Matches joined by spaces come back in order, each ending with a token that ends a word; words
        that normalising may change go to the library one by one."""
        found = [(w,) if self.plain(w) else self.split(w) if self.signs(w) else () for w in words]
        matches = list(chain.from_iterable(found))
        ids = np.array(self.bare.encode_batch_fast([" ".join(matches).translate(self.shown)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(matches) + 1:
            raise ValueError("a token of the vocabulary ends a word within it")
        raw, cuts = ids.tobytes(), [0, *(4 * ends[np.cumsum([len(f) for f in found], dtype=np.int64)]).tolist()]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, f in zip(words, found) if not f], add_special_tokens=False))
        return [raw[a:b] if f else np.array(next(rest).ids, "<u4").tobytes() for f, a, b in zip(found, cuts, cuts[1:])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all texts."""
        low = pc.if_else(pc.match_substring(texts, "\u0307"), texts, pc.ascii_lower(texts))  # I and a dot above are one character to the library
        low = pc.replace_substring_regex(low, "([0-9A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?]+)", r"\1 \2")
        words = pc.ascii_split_whitespace(low)
        ends, ids = by_word(words.flatten(), self.memo.learn)
        return np.diff(ends[words.offsets.to_numpy() - words.offsets[0].as_py()]), ids


_made: dict[bytes, WordIds] = {}


def _word_ids(model: bytes) -> WordIds:
    key = hashlib.sha256(model).digest()
    if key not in _made:
        _made.clear()
        _made[key] = WordIds(model)
    return _made[key]


def _file(order: int, doc_ids: list[int | None], counts: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pack_file(order, doc_ids, counts, np.concatenate(held))], pa.binary())], ["blob"])


def write_token_files(docs: DataFrame, path: str | None = None, model_path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", ids_a_file: int = 4_000_000) -> str:
    """Tokenize every text, append ``end_id``, and write the files to a folder, whose path is returned.

    A file ends with the document that brings it to ``ids_a_file``; a document is never split.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        model = f.read()
    if len(model) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {len(model)} bytes is too large to broadcast")
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = _word_ids(sent.value), TaskContext.get().partitionId(), 0
        doc_ids, counts, held, total = [], [], [], 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for lo, hi in byte_slices(b.column(1)):
                n, ids = coder.encode(b.column(1).slice(lo, hi - lo))
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = np.cumsum(n)
                first = used = 0  # documents and ids of this slice that are in files
                while first < len(n):
                    last = min(int(np.searchsorted(ends, used + ids_a_file - total)) + 1, len(n))
                    doc_ids += keys[lo + first : lo + last]
                    counts += n[first:last].tolist()
                    held.append(ids[used : ends[last - 1]])
                    total += int(ends[last - 1]) - used
                    first, used = last, int(ends[last - 1])
                    if total >= ids_a_file:
                        yield _file(part << 32 | number, doc_ids, counts, held)
                        number += 1
                        doc_ids, counts, held, total = [], [], [], 0
        if doc_ids:
            yield _file(part << 32 | number, doc_ids, counts, held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    tasks = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows that share an identifier, or have none, are ordered by a hash of their texts, and so dealt to many tasks.
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    return blobs_out(rows.mapInArrow(released(run), "blob binary"), "blob", path or work_dir(spark, "token-files"))


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files, and its ids if wanted.

    ``start`` counts the ids of all documents before it, through all files in order.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                order, doc_ids, counts, got = read_file(data)
                ends = np.cumsum(counts)
                raw = got.astype("<u4").tobytes()
                each = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array([order] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(each, pa.binary())] * ids, names)

    names = ["file", "doc_id", "within", "n_tokens", "ids_crc32", *["ids"] * ids]
    schema = "file long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    found = cut(blobs_in(spark, path).select("content").mapInArrow(released(run), schema), "token-index")
    # A running sum over the files of each writing task, and one over the tasks, whose number is set, not grown.
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("task", F.shiftright("file", 32))
    tasks = files.groupBy("task").agg(F.sum("n").alias("n")).withColumn("earlier", before(Window.orderBy("task"))).drop("n")
    files = files.withColumn("before", before(Window.partitionBy("task").orderBy("file"))).join(tasks, "task")
    return found.join(files.select("file", (F.col("earlier") + F.col("before")).alias("before")), "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the files in the shared folder, read them back, and return ``read_token_files``."""
    path = write_token_files(docs, **options)
    out = read_token_files(docs.sparkSession, path)
    if "path" not in options:
        remove(path)
    return out
