"""Planted manuscripts: the driver's tables have no annotations, so queries over annotations make their input.

Each order is a manuscript; each of its lines is a segment whose kind goes by order and line, joined by
spaces. ``SEGMENTS`` says where each segment stands, by arithmetic alone, for the SQL that says what a
scanner must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import table

KIND = "(l_orderkey + l_linenumber) % 8"
COLOR = "CASE l_returnflag WHEN 'A' THEN 'red' WHEN 'N' THEN 'green' ELSE 'nocolor' END"
SEG = f"""CASE {KIND}
 WHEN 0 THEN concat('{{++add', l_partkey, '++}}')
 WHEN 1 THEN concat('{{--del', l_partkey, '--}}')
 WHEN 2 THEN concat('{{~~old', l_suppkey, '~>new', l_partkey, '~~}}')
 WHEN 3 THEN concat('{{>>note ', l_partkey, '<<}}')
 WHEN 4 THEN concat('==hl', l_partkey, '=={{', {COLOR}, '}}')
 WHEN 5 THEN concat('[@p', l_partkey, '; see @p', l_suppkey, ', p. 4]')
 WHEN 6 THEN concat('`code [@p1] ', l_partkey, '`')
 ELSE concat('plain', l_partkey) END"""
ORDER = "l_linenumber, l_partkey, l_suppkey, l_returnflag"

#: SQL with one row per segment: doc_id, ord, kind, a, b, color, seg, s (0-based start).
SEGMENTS = f"""
 r AS (SELECT l_orderkey AS doc_id, {KIND} AS kind, l_partkey AS a, l_suppkey AS b, {COLOR} AS color, {SEG} AS seg,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS ord FROM lineitem),
 segs AS (SELECT *, CAST(coalesce(sum(length(seg) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM r)"""


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of the planted manuscripts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct(*[F.col(c.strip()) for c in ORDER.split(",")], F.expr(SEG).alias("seg")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.seg), " ").alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments as rows, for queries on parsed annotations: ``doc_id, ord, kind, a, b, color``."""
    w = Window.partitionBy("doc_id").orderBy(*[c.strip() for c in ORDER.split(",")])
    rows = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey"))
    return rows.select("doc_id", F.row_number().over(w).alias("ord"), F.expr(KIND).alias("kind"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.expr(COLOR).alias("color"))


#: A bibliography from parts; every part whose key leaves 3 after division by 7 is missing.
BIB_WHERE = "p_partkey % 7 <> 3"


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key`` and fields of the entries."""
    p = table(spark, sf_dir, "part").where(BIB_WHERE)
    return p.select(F.concat(F.lit("p"), F.col("p_partkey")).alias("key"), F.col("p_partkey").alias("part"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
