"""Keys told apart within their scopes, without gathering a scope."""

import random

from scriptorium.functions import scan
from scriptorium.operators import bib


def plain(keys, taken=()):
    """Each key tried with 2, 3, ... from the start."""
    seen, out = set(taken), []
    for k in keys:
        new, n = k, 2
        while new in seen:
            new, n = f"{k}{n}", n + 1
        seen.add(new)
        out.append(new)
    return out


def test_lists_of_keys():
    r = random.Random(1)
    for _ in range(500):
        keys = [r.choice(["k", "k2", "k22", "k3", "j", "j1", ""]) for _ in range(r.randrange(30))]
        taken = set(r.sample(["k", "k2", "k3", "k4", "j"], 2))
        assert scan.disambiguate(keys, taken) == plain(keys, taken)
    assert scan.disambiguate(["k"] * 100_000)[-1] == "k100000"


def test_tables_of_keys(spark):
    r = random.Random(2)
    rows = [(f"s{r.randrange(4)}", r.randrange(60), r.randrange(1000)) for _ in range(400)]
    base = {i: r.choice(["doe2001", "doe200", "doe", "roe", "roe2", "poe"]) for i in range(60)}
    df = spark.createDataFrame([(s, i, base[i], o) for s, i, o in rows], "scope string, item int, base string, ord int").repartition(3)
    want = {}
    for scope in {s for s, *_ in rows}:
        first = {}
        for s, i, o in rows:
            if s == scope:
                first[i] = min(o, first.get(i, o))
        order = sorted(first, key=lambda i: (first[i], i))
        want |= {(scope, i): k for i, k in zip(order, plain([base[i] for i in order]))}
    assert {(x.scope, x.item): x.key for x in bib.key_table(df).collect()} == want


def test_a_scope_of_a_million_items(spark):
    df = spark.range(1_000_000).selectExpr("1 AS scope", "id AS item", "concat('k', CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END, CASE WHEN id % 1000 = 1 THEN '2' ELSE '' END) AS base", "id AS ord")
    keys = bib.key_table(df)
    assert keys.select("key").distinct().count() == 1_000_000
    assert keys.where("key = 'kx'").first().item == 0 and keys.where("key = 'kx500000'").first().item == 999_998


def test_scopes_are_dealt_by_an_exchange_of_their_own(spark):
    """One that Spark may neither plan away nor split, though the join below deals by scope and stem already."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(60).selectExpr("id % 10 AS scope", "id AS item", "concat('k', id % 3) AS base", "id AS ord")
        plan = bib.key_table(df)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan[plan.index("MapInArrow") :]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_path_that_all_documents_name(spark):
    c = spark.range(5000).selectExpr("id AS doc_id", "explode(array(struct(0 AS priority, concat('own/', id) AS path), struct(1 AS priority, 'default' AS path))) AS x").select("doc_id", "x.*")
    files = spark.range(5000).where("id % 3 = 0").selectExpr("concat('own/', id) AS path").unionByName(spark.sql("SELECT explode(array('default', 'default', 'other')) AS path"))
    got = bib.resolve_paths(c, files)
    assert {r.doc_id: r.path for r in got.collect()} == {n: f"own/{n}" if n % 3 == 0 else "default" for n in range(5000)}
    assert "__salt" in got._jdf.queryExecution().optimizedPlan().toString()
