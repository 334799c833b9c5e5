"""Column expressions of texts: references, identifiers, front matter."""

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import bib
from scriptorium.plans.texts import COMMENT_ID


def test_references_beyond_the_characters(spark):
    t = spark.createDataFrame([("a&#1114112;b&#xD800;c&#57343;d&#x10FFFF;&#65279;&#9999999;&#xfeff;&#200;",)], "t string")
    assert t.select(T.decode_entities(F.col("t"))).first()[0] == "a\ufffdb\ufffdc\ufffdd\U0010ffff\ufeff\ufffd\ufeff\u00c8"


def test_front_matter_is_read_once_to_be_written(spark):
    out = bib.write_front(bib.front_matter(F.col("t")))
    df = spark.createDataFrame([("---\ntitle: A\nauthor: B\nfont-size: 12pt\n---\nx",)], "t string").select(out.alias("o"))
    assert df.first().o == "---\ntitle: A\nauthor: B\nfont-size: 12\n---\n"
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(t") == 1


def test_comment_identifiers_are_those_of_the_sql(spark):
    df = spark.createDataFrame([(n,) for n in (0, 35, 36, 1295, 1296, 46655, 46656, 120000)], "p_partkey long").selectExpr(COMMENT_ID)
    assert [r[0] for r in df.collect()] == ["0", "z", "10", "zz", "100", "zzz", "00", "lc"]


def test_a_small_file_is_spread_over_the_cores(spark, tmp_path):
    from scriptorium.plans import documents

    spark.range(100).selectExpr("id AS p_partkey", "'n' AS p_name", "'t' AS p_type", "'b' AS p_brand", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = documents.block_kinds(spark, str(tmp_path))
    assert df.count() == 800 and df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
