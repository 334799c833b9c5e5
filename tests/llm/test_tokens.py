import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer, models

from scriptorium.llm import byte_bpe, token_files, unigram_counts

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a ", "\n\n x", "a" * 3000, "aaab" * 40, "é漢字😀", "\x00\x1c\x85\xa0", "don't 'st", "<|endoftext|>", "é İ ΑΣ ", "_a_ ._x", "12 345"]


def odd_texts(n=300, letters="aab  \n\t\x1c\x85\xa0 éß漢😀'st12..!_\0Ω"):
    rnd = random.Random(7)
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def test_ids_are_those_of_the_ranks_and_decode(ranks):
    ours = byte_bpe.ByteBPE(ranks, P.PATTERN)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = odd_texts() + odd_texts(300, "aaab")
    for t, ids in zip(texts, ours.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t), t
        assert ours.decode(ids) == t.encode()


def test_offsets_cover_split_characters(ranks):
    ours = byte_bpe.ByteBPE(ranks, P.PATTERN)
    t = "h漢😀x"
    ids = ours.encode([t])[0]
    spans = ours.offsets(ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(t)
    assert all(a < b for a, b in spans)


def test_encode_and_decode_documents(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "漢" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = byte_bpe.encode_documents(df).collect()
    assert len(got) == 4
    for r in got:
        t = {1: "a b", None: "", 2: "漢" * 2000}[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.n_tokens == len(r.ids) // 4
    assert byte_bpe.encode_documents(df.limit(0)).collect() == []
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(df))
    assert {r.text for r in back.collect()} == {"a b", "", "漢" * 2000}


def test_words_pack_any_values():
    rnd = np.random.default_rng(3)
    for k in range(60):
        n = int(rnd.integers(0, 300))
        v = np.array([int(rnd.integers(0, 2**63)) * 2 >> 64 - int(b) if b else 0 for b in rnd.integers(0, 65 if k % 2 else 18, n)], np.uint64)
        words, index = token_files.pack(v, 64)
        assert index[-1] == len(words)
        for i in range(len(index) - 1):
            assert (token_files.unpack(words[index[i] : index[i + 1]], min(64, n - 64 * i)) == v[64 * i : 64 * i + 64]).all()


def test_one_block_can_be_read_alone():
    ids = np.arange(10_000, dtype=np.uint32) * 5 % 49_000
    data = token_files.pack_file(1, [7], [10_000], ids) + b"\n"
    assert (token_files.read_file(data, range(1, 2))[3] == ids[4096:8192]).all()


def test_token_files_against_the_library(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    texts = [*odd_texts(150), None]
    rnd = random.Random(2)
    ids = rnd.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in token_files.token_files(df, ids_a_file=500).collect()}
    start = 0
    for i, x in sorted(zip(ids, texts)):
        want = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes())), x
        start += len(want)
    assert token_files.token_files(df.limit(0)).collect() == []


def test_ids_of_any_character_and_of_signs_after_it():
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        model = f.read()
    ours, lib = token_files.WordIds(model), Tokenizer.from_buffer(model)
    lib.encode_special_tokens = True
    shapes = ("{}", "a{}.", "{}.b", "I{}!", "x. {}?y")
    texts = [f.format(chr(c)) for c in range(1, 0x3000) for f in shapes]
    texts += odd_texts(5000, "aaIİbé.,;:!?' \n\t\x1c\x85\xa0ßΣσ漢😀st12_-̧̇AÉK\0<|>")
    n, ids = ours.encode(pa.array(texts))
    assert len(ids) == n.sum()
    for t, e, want in zip(texts, np.split(ids, np.cumsum(n)[:-1]), lib.encode_batch_fast(texts, add_special_tokens=False)):
        assert e.tolist() == want.ids, t


def test_long_texts_and_files_of_any_size(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(3, "ab" * 300_000), (1, "a b. " * 100_000), (2, None), (2, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS file", "2 AS n_tokens", "3 AS within")
    for size in (1, 1000, 4_000_000):
        got = token_files.token_files(df, ids_a_file=size).orderBy("start").collect()
        assert [r.doc_id for r in got] == [None, 1, 2, 2, 3]
        start = 0
        for r, x in zip(got, ["y", rows[1][1], "", "x", rows[0][1]]):
            want = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
            start += len(want)


def test_unigram_counts_against_the_library(spark):
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        vocabulary = unigram_counts.read_model(f.read())
    small = [("<unk>", -1.0, 2), *[(p, s, 1) for p, s in (("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("▁", -1.0), ("▁a", -2.0), ("bb", -1.5))]]
    for v, letters in ((vocabulary, "aab the eré漢😀'12Ω\n"), (small, "aabb xy")):
        lib = Tokenizer(models.Unigram([(p, s) for p, s, _ in v], unk_id=0, byte_fallback=v is vocabulary))
        ours = unigram_counts.UnigramCounter(v)
        texts = odd_texts(300, letters)
        for t, (n, _) in zip(texts, ours.count(texts)):
            assert n == (len(lib.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0), t
    if os.path.exists(SF):
        table = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()
        lib, ours = Tokenizer(models.Unigram([(p, s) for p, s, _ in vocabulary], unk_id=0, byte_fallback=True)), unigram_counts.UnigramCounter(vocabulary)
        for t, (n, _) in zip(table, ours.count([x or "" for x in table])):
            assert n == (len(lib.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0)
    clash = spark.createDataFrame([(1, "the a", 5, 6.0)], "doc_id long, text string, n_tokens long, score double")
    assert unigram_counts.count_tokens(clash).count() == 1 and unigram_counts.count_tokens(clash.limit(0)).collect() == []
    got = unigram_counts.count_tokens(spark.createDataFrame([(1, None), (2, "the a"), (2, "the a")], "doc_id long, text string")).collect()
    lib = Tokenizer(models.Unigram([(p, s) for p, s, _ in vocabulary], unk_id=0, byte_fallback=True))
    n = len(lib.encode("▁the▁a", add_special_tokens=False).ids)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 0), (2, n), (2, n)]


def test_rows_without_identifiers_are_dealt_to_many_tasks(spark, tmp_path):
    from scriptorium.llm.token_files import read_token_files, write_token_files

    docs = spark.createDataFrame([(None if k % 3 == 0 else k, f"text number {k} " * 5) for k in range(3000)], "doc_id long, text string").repartition(8)
    path = write_token_files(docs, path=f"file://{tmp_path}/f")
    sizes = [f.stat().st_size for f in (tmp_path / "f").glob("part-*")]
    assert len(sizes) >= 4 and max(sizes) < 2.5 * sum(sizes) / len(sizes)
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 1000 + sorted(k for k in range(3000) if k % 3)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
