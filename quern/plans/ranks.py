"""Nodes, edges and page ranks that several plans read, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normal_name
from quern.operators import graph as G
from quern.runtime import cut, table

#: Relations that count as links between pages.
PAGE_LINKS = ("wiki_link", "lead_link", "infobox_link")


def nodes_of(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "page_nodes").unionByName(table(spark, sf, "core_nodes"))
    return both.withColumn("id", normal_name(F.col("id")))


def edges_of(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "graph_edges")
    return raw.select("edge_id", normal_name(F.col("source")).alias("source"), normal_name(F.col("target")).alias("target"), "relation", "field", "weight", "built_at")


def page_ranks(spark: SparkSession, sf: str, edges: DataFrame | None = None) -> DataFrame:
    """id, rank of the pages: PageRank over all links from pages to pages, where n is all nodes.

    edges: those of ``edges_of``, if they are written already.
    """
    nodes, edges = nodes_of(spark, sf), edges_of(spark, sf) if edges is None else edges
    pages = cut(G.merge_nodes(nodes, "node_key", ["kind"]).where(F.col("kind") == "page").select("id"), "pages")
    links = edges.where(F.col("relation").isin(*PAGE_LINKS) & F.col("target").startswith("page:") & (F.col("source") != F.col("target")))
    return cut(G.pagerank(nodes, links.join(pages.select(F.col("id").alias("source")), "source", "left_semi")).join(pages, "id", "left_semi"), "page-ranks")


N = r"lower(trim(regexp_replace(replace({}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')))".format


def rank_sql(where: str, rounds: int = 25) -> str:
    """SQL: id, rank by the given links; where is over source, target and relation, and ``pg`` holds the pages."""
    return f"""WITH RECURSIVE n0 AS (SELECT {N('id')} AS id, kind FROM page_nodes UNION ALL SELECT {N('id')}, kind FROM core_nodes), nodes AS (SELECT DISTINCT id FROM n0), pg AS (SELECT DISTINCT id FROM n0 WHERE kind = 'page'),
e AS (SELECT source, target, sum(weight) AS w FROM (SELECT {N('source')} AS source, {N('target')} AS target, weight, relation FROM graph_edges) WHERE source <> target {where} AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY 1, 2),
s AS MATERIALIZED (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS share FROM e), c AS (SELECT count(*) AS n FROM nodes), l AS MATERIALIZED (SELECT id, id NOT IN (SELECT source FROM s) AS loose FROM nodes),
r AS (SELECT 0 AS i, id, loose, 1.0::DOUBLE / n AS rank FROM l, c UNION ALL
 SELECT p.i + 1, p.id, p.loose, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + p.free / c.n) FROM (SELECT r.*, coalesce(sum(CASE WHEN loose THEN rank END) OVER (), 0) AS free FROM r WHERE r.i < {rounds}) p CROSS JOIN c LEFT JOIN (SELECT s.target, sum(r.rank * s.share) AS got FROM r JOIN s ON r.id = s.source GROUP BY 1) g ON g.target = p.id)
SELECT r.id, rank FROM r WHERE i = {rounds}"""


PAGE_RANKS = rank_sql(f"AND relation IN {PAGE_LINKS} AND target LIKE 'page:%' AND source IN (SELECT id FROM pg)") + " AND r.id IN (SELECT id FROM pg)"
