import math

import pytest
from pyspark.sql import functions as F

from quern.functions.text import phrase, tokens
from quern.operators import search as S

PAGES = "node string, title string, aliases array<string>, categories array<string>, recipes array<array<struct<kind:string,name:string>>>, rank double, at int"
RECIPE = [[("materials", "Raw shrimp"), ("tools", "Tin pot lid box"), ("outputs", "Cooked shrimp"), ("skills", "")]]
ROWS = [
    ("p1", "Silver Ring", ["Band", None], None, None, 0.001, 1), ("p2", "Ring", None, ["Burnt  food"], None, None, 2), ("p3", "Burnt stew", ["Stew"], None, None, 0.0, 3),
    ("p4", "Shrimp", [], ["Food"], RECIPE, 0.0, 4), ("p5", "Plain", None, None, None, 0.9, 5), ("p6", "The band", ["silver_ring"], None, None, 0.0, 6),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, PAGES)


def ask(spark, pages, *texts):
    index = S.postings(pages, "node", {"title": F.col("title"), "alias": F.array_join(F.coalesce("aliases", F.array()), " ")})
    queries = spark.createDataFrame([(t, t) for t in texts], "query string, text string")
    return {(r.query, r.node): (r.score, r.strong, r.rn) for r in S.search(queries, index, S.title_index(pages), pages, 10).collect()}


def test_names_lead_to_the_last_page_that_has_them(spark, pages):
    got = {r.name: r.node for r in S.title_index(pages).collect()}
    assert got["silver ring"] == "p6" and got["band"] == "p1" and got["the band"] == "p6" and got["stew"] == "p3"
    refs = spark.createDataFrame([(1, " SILVER__ring"), (2, "nothing"), (3, None)], "i int, t string")
    assert {r.i: r.node for r in S.resolve(refs, "t", S.title_index(pages)).collect()} == {1: "p6", 2: None, 3: None}


def test_points(spark, pages):
    got = ask(spark, pages, "silver ring", "burnt stew", "shrimp cooked in tin pot", "", "zzz")
    rank = round(2 * math.log1p(0.001 * 1e5), 6)
    # Both words of the title, the query in it, its phrase in the query.
    assert got["silver ring", "p1"] == (round(24 + 25 + 250 + rank, 6), True, 2)
    # The alias "silver_ring" is one token, but the name resolves, and its phrase is in the query.
    assert got["silver ring", "p6"] == (100.0 + 250, True, 1)
    assert got["silver ring", "p2"] == (12.0 + 40 - 90, True, 3) and got["silver ring", "p3"] == (-90.0, False, 4)
    # Burnt things are not held back where they are asked for.
    assert got["burnt stew", "p3"] == (24 + 10 + 100 + 25 + 250.0, True, 1) and ("burnt stew", "p2") not in got
    # Recipe: half of raw shrimp 15, two of four words 15, both words of the output 25; the title as a phrase of one word 40.
    assert got["shrimp cooked in tin pot", "p4"] == (12 + 40 + 15 + 15 + 25.0, True, 1)
    assert {k for k in got if k[0] in ("", "zzz")} == {(q, p) for q in ("", "zzz") for p in ("p2", "p3")}
    assert ask(spark, pages.where("false"), "silver ring") == {}


def test_too_many_queries(spark, pages):
    queries = spark.range(5).select(F.col("id").cast("string").alias("query"), F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        S.search(queries, spark.createDataFrame([], "token string, node string, weight double"), S.title_index(pages), pages, 3, most_queries=4)


def test_the_best_recipe_counts(spark):
    kind = "array<array<struct<kind:string,name:string>>>"
    rows = [([[("tools", "pot")], [("materials", "raw shrimp"), ("outputs", "raw shrimp")]],), ([[("tools", "pot")]],), ([[]],), (None,), ([[("tools", None)]],)]
    said = F.lit("a pot of raw shrimp")
    got = spark.createDataFrame(rows, f"r {kind}").select(S.recipe_score(F.col("r"), tokens(said), phrase(said))).collect()
    assert [r[0] for r in got] == [120.0, 45.0, 0.0, 0.0, 0.0]


def test_catalog_points(spark):
    rows = spark.createDataFrame([("Iron ring", "iron_ring", ["old iron"]), ("Ring", None, None), (None, "ring_iron", [])], "n string, d string, t array<string>")
    got = [r[0] for r in rows.select(S.catalog_score("Iron, ring x", F.col("n"), F.col("d"), F.col("t"))).collect()]
    assert got == [3 + 3 + 2 + 2 + 1.5 + 12 + 10, 2.0, 6.0] and rows.select(S.catalog_score("x", F.col("n"), F.col("d"), F.col("t"))).first()[0] == 0.0
