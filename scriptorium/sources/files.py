"""Manuscripts, bibliographies and packages as files, read and written through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``path, text``, one row per file."""
    t = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of Word files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path).select("path", "content")


def write_text(df: DataFrame, path: str, force: bool = False, text: str = "text", by: str | None = None) -> None:
    """Texts as files, one per row; what is there already stands in the way unless ``force``."""
    w = df.select(*([by] if by else []), F.col(text).alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1)
    w = w.partitionBy(by) if by else w
    w.mode("overwrite" if force else "errorifexists").text(path)


def base_path(path: Column) -> Column:
    """A path without its ending of a manuscript or package."""
    return F.regexp_replace(path, r"(?i)\.(md|docx|markdown)$", "")


def direction(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".docx"), "to_markdown").when(F.lower(path).rlike(r"\.(md|markdown)$"), "to_docx")


def conflict(md: Column, bib: Column) -> Column:
    """Which outputs are there already: none, md, bib or both."""
    return F.when(md & bib, "both").when(md, "md").when(bib, "bib").otherwise("none")
