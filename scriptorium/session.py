"""Session settings and the few things that every query needs from a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent


def build(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("scriptorium")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers, once a session.

    Nothing is done where PYTHONPATH already has it; elsewhere a zip of the sources goes out with
    ``addPyFile``, so that workers keep their per-process caches (functions pickled by value would
    not).
    """
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if os.path.realpath(ROOT) in paths or getattr(sc, "_scriptorium_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "scriptorium").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(out))
    sc._scriptorium_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, under the one that ``spark.checkpoint.dir`` names (on one machine: a temporary one)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='scriptorium-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed and its lineage cut, kept in the folder that ``spark.checkpoint.dir`` names."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="scriptorium-"))
    return df.checkpoint()


def dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with the rows of each value of ``by`` in one task, next to each other and in ``order``.

    Python that keeps state from row to row needs that, but Spark does not know: a plain repartition by columns that a join or a
    window below has dealt the rows by already is planned away, and then that join may be split or read locally. Rows are dealt by a
    hash of the columns instead, which is no partitioning of anything below.
    """
    return df.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in four tasks a core: a small file gives few tasks, however long the work on each of its rows is."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
