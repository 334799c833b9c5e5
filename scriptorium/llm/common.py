"""Shared plumbing of the operators: input columns, the shared folder, blobs in files."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ship, table

__all__ = ["blobs_in", "blobs_out", "collected", "cut", "free_name", "released", "remove", "ship", "swept", "table", "text_of", "work_dir", "written"]


#: Folders that ``cut`` wrote and nothing has removed yet.
_left: set[str] = set()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share.

    It lies under ``spark.checkpoint.dir``. Where that is unset (tests on one machine), a temporary
    folder of this machine serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark.sparkContext, "_scriptorium_tmp", None) or tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext._scriptorium_tmp = base
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (in folders by column ``by``) and read again: a lost executor costs no recomputation.

    A result may be read long after its query was built, so what ``remove`` has not deleted goes when
    the application ends.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    if not _left:
        atexit.register(lambda: [remove(p) for p in list(_left)])
    _left.add(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scriptorium_path = path
    return out


def remove(df: DataFrame | str) -> None:
    """Delete what ``cut`` or ``blobs_out`` wrote."""
    spark = SparkSession.getActiveSession()
    path = df if isinstance(df, str) else getattr(df, "_scriptorium_path", None)
    if path and spark and spark.sparkContext._jsc is not None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _left.discard(path)


def swept(before: set[str], *kept: DataFrame) -> None:
    """Delete what ``cut`` has written since ``before = written()``, but for the tables in ``kept``."""
    stay = {getattr(df, "_scriptorium_path", None) for df in kept}
    for path in _left - before - stay:
        remove(path)


def collected(spark: SparkSession) -> None:
    """Collect the driver's garbage, between steps of long work.

    Shuffle files and broadcasts of finished queries go with it, and the heap that they took is given back.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written() -> set[str]:
    """The folders that ``cut`` wrote and nothing has removed."""
    return set(_left)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has (names are told apart without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(run):
    """A function of batches whose worker gives memory back when a task ends.

    Workers are used again by other operators, and what an allocator keeps counts as the executor's.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_of(c: str | Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blobs_out(df: DataFrame, blob: str, path: str, end: str = "\n") -> str:
    """Write each value of a binary column as one file of its own, followed by ``end`` (one character at least).

    Spark's text writer serves as the byte writer, so that any store which Spark can write to will
    do. Each value should be some tens of MB at most; the caller bounds that.
    """
    df.select(F.col(blob).cast("string").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", 1).text(path)
    return path


def blobs_in(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the files that ``blobs_out`` wrote (``content`` has their ``end``)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
