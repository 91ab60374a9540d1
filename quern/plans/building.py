"""Records to a graph, redirects, phrases in texts, and formats of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.coords import map_square
from quern.functions.text import gold_amount, normal_name, play_time, stack_amount
from quern.operators import graph_build as B
from quern.operators import search as S
from quern.runtime import table


def _records(spark: SparkSession, sf: str) -> DataFrame:
    links = F.transform(F.filter("links", lambda x: (x["ns"] == 0) & ~F.coalesce(~x["exists"], F.lit(False))), lambda x: x["title"])
    return table(spark, sf, "raw_pages").where(F.col("title").isNotNull()).select("raw_id", "title", links.alias("links"), F.transform("categories", lambda x: x["category"]).alias("categories"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("wiki_link", F.col("links"), "page"), ("in_category", F.col("categories"), "category")]
    return B.edges_from(_records(spark, sf), B.page_id(F.col("title")), rules)


def graph_edges_built(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).groupBy("source", "target", "relation").agg(F.sum("weight").alias("weight"))


def graph_nodes_built(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf).withColumn("id", B.page_id(F.col("title"))).groupBy("id").agg(F.min("raw_id").alias("first"))
    return B.nodes_from(records, F.col("id"), _edges(spark, sf), {"first": F.col("first")}).select("id", "kind", "first")


def redirect_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Requested titles of fetches led to the titles they were redirected to."""
    pages = table(spark, sf, "raw_pages")
    redirects = pages.where(F.col("crawl.redirected") & (normal_name(F.col("requested_title")) != normal_name(F.col("title")))).select(F.col("requested_title").alias("from"), F.col("title").alias("to"))
    return B.follow_redirects(pages.select("raw_id", "requested_title"), redirects, "requested_title").select("raw_id", "target")


def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of core nodes in page titles."""
    texts = table(spark, sf, "page_nodes").select("node_key", "title")
    phrases = table(spark, sf, "core_nodes").select(F.col("id").alias("core"), "label")
    return B.phrases_in(texts, phrases, "title", "label").select("node_key", "core")


def square_join(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers of the same map square, counted per square."""
    p = table(spark, sf, "part").select(map_square((3000 + F.col("p_partkey") * 7919 % 400).cast("int")).alias("sx"), map_square((3200 + F.col("p_partkey") * 104729 % 400).cast("int")).alias("sz")).groupBy("sx", "sz").agg(F.count(F.lit(1)).alias("parts"))
    s = table(spark, sf, "supplier").select(map_square((3000 + F.col("s_suppkey") * 6151 % 400).cast("int")).alias("sx"), map_square((3200 + F.col("s_suppkey") * 3079 % 400).cast("int")).alias("sz")).groupBy("sx", "sz").agg(F.count(F.lit(1)).alias("suppliers"))
    return p.join(s, ["sx", "sz"])


def value_formats(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.floor(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 100).otherwise(1)).cast("bigint")
    seconds = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    big = amount * F.when(F.col("o_orderkey") % 5 == 0, 1000).otherwise(1)
    return table(spark, sf, "orders").select("o_orderkey", gold_amount(amount).alias("amount"), stack_amount(big).alias("stack"), play_time(amount).alias("played"), seconds.alias("at"))


def json_items(spark: SparkSession, sf: str) -> DataFrame:
    """Item lists to JSON text and back, with a total over what was read."""
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.floor("l_quantity")).alias("n"))
    text = lines.groupBy("l_suppkey").agg(F.to_json(F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.col("n").alias("n")))).alias("items"))
    back = F.from_json("items", "array<struct<id bigint, n bigint>>")
    return text.select("l_suppkey", F.size(back).alias("items"), F.aggregate(back, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("total"))


def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best parts for a few words: in the name, in the type as its written key, and in the brand as its tag."""
    debug = F.translate(F.lower("p_type"), " ", "_")
    scored = S.catalog_score("Steel  ring, brand 3", F.col("p_name"), debug, F.array("p_brand"))
    found = table(spark, sf, "part").select("p_partkey", "p_name", scored.alias("score")).where(F.col("score") > 0)
    return found.orderBy(F.desc("score"), "p_name", "p_partkey").limit(10)


QUERIES = {f.__name__: f for f in (graph_edges_built, graph_nodes_built, redirect_targets, phrase_match, square_join, value_formats, json_items, catalog_search)}
_N = r"lower(trim(regexp_replace(replace({}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')))".format
_E = f"""WITH r AS (SELECT raw_id, 'page:' || {_N('title')} AS source, list_filter(list_transform(list_filter(links, lambda x: x.ns = 0 AND coalesce(x.exists, true)), lambda x: x.title), lambda t: trim(t) <> '') AS ls, list_filter(list_transform(categories, lambda x: x.category), lambda t: trim(t) <> '') AS cs FROM raw_pages WHERE title IS NOT NULL),
e AS (SELECT source, 'page:' || {_N('t')} AS target, 'wiki_link' AS relation, 1.0::DOUBLE AS weight FROM (SELECT source, unnest(ls[1:100]) AS t FROM r) UNION ALL SELECT source, 'category:' || {_N('t')}, 'in_category', 0.5::DOUBLE FROM (SELECT source, unnest(cs) AS t FROM r)) """
_TOK = lambda c: f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9''+_\\-]*'), lambda t: length(t) > 1)"
ORACLE = {
    "graph_edges_built": _E + "SELECT source, target, relation, sum(weight) AS weight FROM e GROUP BY 1, 2, 3",
    "graph_nodes_built": _E + ", p AS (SELECT source AS id, min(raw_id) AS first FROM r GROUP BY 1) SELECT id, 'page' AS kind, first FROM p UNION ALL SELECT DISTINCT target, split_part(target, ':', 1), NULL FROM e WHERE target NOT IN (SELECT id FROM p)",
    "redirect_targets": f"WITH d AS (SELECT {_N('requested_title')} AS f, min(title) AS t FROM raw_pages WHERE crawl.redirected AND {_N('requested_title')} <> {_N('title')} GROUP BY 1) SELECT raw_id, coalesce(t, requested_title) AS target FROM raw_pages LEFT JOIN d ON {_N('requested_title')} = f",
    "phrase_match": f"WITH t AS (SELECT node_key, array_to_string({_TOK('title')}, ' ') AS x FROM page_nodes), c AS (SELECT id AS core, array_to_string({_TOK('label')}, ' ') AS y FROM core_nodes) SELECT node_key, core FROM t JOIN c ON y <> '' AND contains(' ' || x || ' ', ' ' || y || ' ')",
    "square_join": "WITH p AS (SELECT (3000 + p_partkey * 7919 % 400) // 64 AS sx, (3200 + p_partkey * 104729 % 400) // 64 AS sz, count(*) AS parts FROM part GROUP BY 1, 2), s AS (SELECT (3000 + s_suppkey * 6151 % 400) // 64 AS sx, (3200 + s_suppkey * 3079 % 400) // 64 AS sz, count(*) AS suppliers FROM supplier GROUP BY 1, 2) SELECT CAST(sx AS INTEGER) AS sx, CAST(sz AS INTEGER) AS sz, parts, suppliers FROM p JOIN s USING (sx, sz)",
    "value_formats": "WITH v AS (SELECT o_orderkey, o_orderdate, CAST(floor(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 1 END) AS BIGINT) AS v FROM orders), b AS (SELECT *, v * CASE WHEN o_orderkey % 5 = 0 THEN 1000 ELSE 1 END AS b, CAST(floor(v * 0.6) AS BIGINT) AS s FROM v) SELECT o_orderkey, CASE WHEN v >= 10000000 THEN (v // 1000000) || 'M' WHEN v >= 100000 THEN (v // 1000) || 'K' ELSE format('{:,}', v) END AS amount, CASE WHEN b >= 1000000000 THEN (b // 1000000000) || 'B' WHEN b >= 1000000 THEN (b // 1000000) || 'M' WHEN b >= 1000 THEN (b // 1000) || 'K' ELSE b::VARCHAR END AS stack, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END || (s % 3600 // 60) || 'm' AS played, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM b",
    "json_items": "SELECT l_suppkey, count(DISTINCT l_partkey) AS items, CAST(sum(floor(l_quantity)) AS BIGINT) AS total FROM lineitem GROUP BY 1",
    "catalog_search": "WITH x AS (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n, replace(lower(p_type), ' ', '_') AS d, lower(p_brand) AS t FROM part), s AS (SELECT p_partkey, p_name, list_sum(list_transform(['steel', 'ring', 'brand'], lambda w: CASE WHEN contains(d, w) THEN 3.0 ELSE 0 END + CASE WHEN contains(n, w) THEN 2.0 ELSE 0 END + CASE WHEN contains(t, w) THEN 1.5 ELSE 0 END)) + CASE WHEN contains(n, 'steel ring brand') THEN 12 ELSE 0 END + CASE WHEN contains(replace(d, '_', ' '), 'steel ring brand') THEN 10 ELSE 0 END AS score FROM x) SELECT p_partkey, p_name, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, p_name, p_partkey LIMIT 10",
}
