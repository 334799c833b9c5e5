"""Citation styles: trees, names, dates, conditions, and telling works apart."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions.styles import AUTHOR_DATE, NUMERIC, Style
from scriptorium.operators.citations import rendered


def work(*names, year=2001, title="T", kind="article-journal", **more):
    return {"type": kind, "title": title, "author": [{"family": n, "given": "Ann B."} for n in names], **({"issued": {"date-parts": [[year]]}} if year else {}), **more}


ITEMS = {
    "one": work("Doe", title="First", **{"container-title": "J"}, volume="4", page="1-9"),
    "two": work("Doe", "Roe", year=1999, title="Second", kind="book"),
    "many": work("Doe", "Roe", "Poe", title="Third"),
    "inst": {"type": "book", "title": "Fourth", "author": [{"literal": "Bell & Sons"}]},
    "none": {"type": "book", "title": "No <names>", "issued": {"date-parts": [[1950, 2, 3]]}},
}


def test_author_date():
    d = Style(AUTHOR_DATE).document([[("one", "p. 3"), ("two", "pp. 4-6")], [("many", None), ("inst", "chap. 2")], [("none", "7"), ("lost", None)]], ITEMS)
    assert d.clusters == ["(Doe 2001, p. 3; Doe &amp; Roe 1999, pp. 4-6)", "(Doe et al. 2001; Bell &amp; Sons n.d., chap. 2)", "(No &lt;names&gt; 1950, p. 7; lost)"]
    assert d.entries == [
        ("inst", "Bell &amp; Sons (n.d.). <i>Fourth</i>."),
        ("one", "Doe, A. B. (2001). First. <i>J</i>, 4, 1-9."),
        ("two", "Doe, A. B., &amp; Roe, A. B. (1999). <i>Second</i>."),
        ("many", "Doe, A. B., Roe, A. B., &amp; Poe, A. B. (2001). Third."),
        ("none", "No &lt;names&gt; (1950). <i>No &lt;names&gt;</i>."),
    ]


def test_numbers_follow_the_order_of_citing():
    d = Style(NUMERIC).document([[("two", None)], [("one", "p. 3"), ("two", None), ("lost", None)]], ITEMS)
    assert d.clusters == ["[1]", "[1, 2, p. 3, lost]"]
    assert d.entries == [("two", "1. A. B. Doe and A. B. Roe, “Second”, 1999."), ("one", "2. A. B. Doe, “First”, <i>J</i>, 2001.")]


def test_names_are_added_while_they_tell_works_apart():
    items = {"a": work("Doe", "Roe", "Poe"), "b": work("Doe", "Roe", "Loe"), "c": work("Doe", "Moe", "Poe"), "d": work("Ray", "Roe", "Poe")}
    d = Style(AUTHOR_DATE).document([[(k, None)] for k in "abcd"], items)
    assert d.clusters == ["(Doe, Roe, &amp; Poe 2001)", "(Doe, Roe, &amp; Loe 2001)", "(Doe, Moe, &amp; Poe 2001)", "(Ray et al. 2001)"]


def test_letters_where_names_do_not_help():
    items = {"x": work("Doe", title="Z"), "y": work("Doe", title="A"), "z": work("Doe", year=2002), "m": work("Doe", "Roe", "Poe", title="1"), "n": work("Doe", "Roe", "Poe", title="2")}
    d = Style(AUTHOR_DATE).document([[("x", None)], [("y", "2")], [("z", None)], [("m", None), ("n", None)]], items)
    assert d.clusters == ["(Doe 2001b)", "(Doe 2001a, p. 2)", "(Doe 2002)", "(Doe et al. 2001a; Doe et al. 2001b)"]
    assert [k for k, _ in d.entries] == ["y", "x", "z", "m", "n"] and d.entries[0][1].startswith("Doe, A. B. (2001a).")
    many = {f"k{n:03d}": work("Doe", title=f"{n:03d}") for n in range(60)}
    d = Style(AUTHOR_DATE).document([[(k, None)] for k in many], many)
    assert d.clusters[25:28] == ["(Doe 2001z)", "(Doe 2001aa)", "(Doe 2001ab)"] and len(set(d.clusters)) == 60


def test_a_style_of_ones_own():
    own = """<style xmlns="http://purl.org/net/xbiblio/csl"><citation><layout delimiter=" / ">
      <choose><if type="book" variable="author" match="all"><text variable="title" text-case="uppercase" font-weight="bold"/></if>
        <else-if is-numeric="volume"><text variable="volume" prefix="v"/></else-if><else><text value="?"/><unknown/></else></choose>
      <date variable="issued" prefix=" " delimiter="-"><date-part name="year"/><date-part name="month"/></date></layout></citation></style>"""
    d = Style(own).document([[("two", None), ("one", None), ("none", None), ("many", None)]], ITEMS)
    assert d.clusters == ["<b>SECOND</b> 1999 / v4 2001 / ? 1950-2 / ? 2001"] and d.entries == []
    with pytest.raises(ValueError):
        Style("<style/>")


def test_documents_in_their_styles(spark):
    cites = [(1, 5, 0, "one", "p. 3", "numeric"), (1, 5, 1, "two", None, "numeric"), (1, 40, 0, "one", None, "numeric"), (2, 0, 0, "two", None, "mine"), (3, 9, 0, "lost", None, "unknown"), (3, 9, 1, "one", None, "unknown")]
    c = spark.createDataFrame(cites, "doc_id long, cluster long, ord int, key string, locator string, style string").repartition(3)
    i = spark.createDataFrame([(k, json.dumps(v)) for k, v in ITEMS.items()], "key string, item string")
    mine = spark.createDataFrame([("mine", '<style><citation><layout><text variable="title"/></layout></citation></style>')], "style string, tree string")
    got = {(r.doc_id, r.kind, r.place): r.text for r in rendered(c, i, mine).collect()}
    assert got == {
        (1, "citation", 5): "[1, p. 3, 2]", (1, "citation", 40): "[1]", (1, "entry", 0): "1. A. B. Doe, “First”, <i>J</i>, 2001.", (1, "entry", 1): "2. A. B. Doe and A. B. Roe, “Second”, 1999.",
        (2, "citation", 0): "Second", (3, "citation", 9): "(Doe 2001; lost)", (3, "entry", 0): "Doe, A. B. (2001). First. <i>J</i>, 4, 1-9.",
    }
    assert rendered(c.limit(0), i).collect() == []


def test_documents_are_dealt_by_an_exchange_of_their_own(spark):
    """One that Spark may neither plan away nor read locally, though the cites come from windows over documents."""
    w = Window.partitionBy("doc_id").orderBy("n")
    one = spark.range(40).selectExpr("id % 5 AS doc_id", "id AS n").select("doc_id", F.row_number().over(w).cast("long").alias("cluster"), F.lit(0).alias("ord"), F.lit("one").alias("key"), F.lit(None).cast("string").alias("locator"), F.lit("numeric").alias("style"))
    items = spark.range(1).select(F.lit("one").alias("key"), F.lit(json.dumps(ITEMS["one"])).alias("item"))
    plan = rendered(one.unionByName(one.withColumn("ord", F.lit(1))), items)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan[plan.index("MapInArrow") :]
