"""Exact duplicates by a tree of merges over sorted digest runs.

Every input partition makes a run: one row per distinct (digest, byte length) that it holds, sorted,
with the identifier that would stay and the number of rows. Runs then meet in rounds, as in a
binomial exchange: a run belongs to an owner, whose number has ``rounds`` digits in base ``fan_in``;
in round ``i`` every entry moves to the owner whose digit ``i`` is that digit of its digest, so each
owner receives from ``fan_in`` partners the part of their runs that it covers and merges them into
one run, in one pass over the rows as Spark's sort delivers them. After the last round an owner
holds all that there is of its digests. A text that a third of all rows share is one entry of each
run, so it is at most ``fan_in`` entries in any merge. Only digests move; no text does.

Equality: identical texts after ``normalise`` (none by default); null counts as empty. Equality is
verified by SHA-256 and byte length together at every merge. Which row stays: the largest identifier
(``keep="max"``) or the smallest. Rows that repeat an identifier each count in ``group_size`` and all
of them are kept or dropped alike. A null identifier stays only where its group has no other; it
comes back as null. Empty tables give empty results. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, remove, ship, text_of

MAX_BROADCAST = 200_000

_RUN = "owner long, sha binary, bytes long, keep long, rows long"


def _merged(keep: str):
    """Merge sorted entries: equal neighbours become one, with the identifier that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last entry, which the next batch may continue
        better = np.fmax if keep == "max" else np.fmin
        none = np.iinfo(np.int64).min if keep == "max" else np.iinfo(np.int64).max
        for b in batches:
            if not b.num_rows:
                continue
            owner = b.column(0).to_numpy(zero_copy_only=False)
            sha = b.column(1).to_pylist()
            size = b.column(2).to_numpy(zero_copy_only=False)
            kept = b.column(3).fill_null(none).to_numpy(zero_copy_only=False)
            rows = b.column(4).to_numpy(zero_copy_only=False)
            new = np.fromiter((True, *(a != c for a, c in zip(sha, sha[1:]))), bool, len(sha))
            new[1:] |= (size[1:] != size[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            best, count = better.reduceat(kept, at), np.add.reduceat(rows, at)
            out = [[int(owner[i]), sha[i], int(size[i]), int(k), int(n)] for i, k, n in zip(at, best, count)]
            if held and held[:3] == out[0][:3]:
                out[0][3], out[0][4] = int(better(out[0][3], held[3])), out[0][4] + held[4]
            elif held:
                out.insert(0, held)
            held = out.pop()
            if out:
                yield _batch(out, none)
        if held:
            yield _batch([held], none)

    return run


def _batch(rows: list[list], none: int) -> pa.RecordBatch:
    owner, sha, size, keep, n = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(owner, pa.int64()), pa.array(sha, pa.binary()), pa.array(size, pa.int64()), pa.array([None if k == none else k for k in keep], pa.int64()), pa.array(n, pa.int64())],
        ["owner", "sha", "bytes", "keep", "rows"],
    )


def _digit(i: int, fan_in: int) -> Column:
    """Digit ``i`` of a digest in base ``fan_in``; three bytes of the digest serve each digit."""
    part = F.conv(F.hex(F.substring("sha", 1 + 3 * i, 3)), 16, 10).cast("long")
    return part % F.lit(fan_in)


def merge_tree(runs: DataFrame, keep: str = "max", fan_in: int = 16, rounds: int | None = None) -> DataFrame:
    """``sha, bytes, keep, rows``: one row per distinct text, from rows ``sha, bytes, keep, rows``."""
    ship(runs.sparkSession)
    tasks = max(runs.rdd.getNumPartitions(), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if rounds is None:
        rounds = 1
        while fan_in**rounds < 4 * tasks and rounds < 8:
            rounds += 1
    owners = fan_in**rounds
    df = runs.withColumn("owner", (F.spark_partition_id() % owners).cast("long"))
    df = df.select("owner", "sha", "bytes", "keep", "rows").sortWithinPartitions("owner", "sha", "bytes").mapInArrow(_merged(keep), _RUN)
    for i in range(rounds):
        unit = fan_in**i
        old = F.floor(F.col("owner") / F.lit(unit)) % F.lit(fan_in)
        df = df.withColumn("owner", (F.col("owner") + (_digit(i, fan_in) - old) * F.lit(unit)).cast("long"))
        df = df.repartition(min(owners, 4 * tasks), "owner").sortWithinPartitions("owner", "sha", "bytes").mapInArrow(_merged(keep), _RUN)
    return df.select("sha", "bytes", "keep", "rows")


def _digests(docs: DataFrame, id_col: str, text_col: str, normalise) -> DataFrame:
    text = text_of(text_col)
    raw = (normalise(text) if normalise else text).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(raw).cast("long").alias("bytes"))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    normalise=None,
    fan_in: int = 16,
    rounds: int | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``normalise`` takes and returns a string column. See the module for how ties, nulls and repeated
    rows come out.
    """
    rows = cut(_digests(docs, id_col, text_col, normalise), "exact-digests")  # the texts are read once
    groups = merge_tree(rows.select("sha", "bytes", F.col("doc_id").alias("keep"), F.lit(1).cast("long").alias("rows")), keep, fan_in, rounds)
    groups = groups.select(F.col("sha").alias("g_sha"), F.col("bytes").alias("g_bytes"), F.col("keep").alias("keep_id"), F.col("rows").alias("group_size"))
    out = rows.join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("bytes") == F.col("g_bytes")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None, fan_in: int = 16, rounds: int | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Rows of ``docs``, all columns: one of each group of equal texts.

    Only groups of two rows or more are sent to the rows (broadcast up to ``max_broadcast`` of them), and
    only the rows that stay of such groups are shuffled, as several of them may have one identifier.
    """
    rows = cut(_digests(docs, id_col, text_col, normalise), "exact-digests")
    groups = merge_tree(rows.select("sha", "bytes", F.col("doc_id").alias("keep"), F.lit(1).cast("long").alias("rows")), keep, fan_in, rounds)
    sha, stays = (free_name(docs, n) for n in ("sha_of_text", "id_that_stays"))
    groups = cut(groups.where("rows > 1").select(F.col("sha").alias(sha), F.col("keep").alias(stays)), "exact-groups")
    remove(rows)
    groups = F.broadcast(groups) if groups.count() <= max_broadcast else groups
    text = text_of(text_col)
    told = docs.withColumn(sha, F.unhex(F.sha2((normalise(text) if normalise else text).cast("binary"), 256)))
    alone = told.join(groups, sha, "left_anti")
    kept = told.join(groups, sha).where(F.col(id_col).cast("long").eqNullSafe(F.col(stays))).drop(stays).dropDuplicates([sha])
    return alone.unionByName(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
