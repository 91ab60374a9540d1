"""Temporal filters and graph queries over page_nodes, core_nodes and graph_edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.dates import date_number, precision
from quern.operators import graph as G
from quern.operators.temporal import available_at, first_excluded
from quern.plans.ranks import PAGE_RANKS, edges_of, nodes_of, page_ranks, rank_sql
from quern.runtime import cut, table

CUT = "2012-06-15"
#: How much a relation counts when edges are ranked for retrieval.
PRIORITY = {
    "lead_link": 5.0, "infobox_link": 4.0, "requires_material": 9.0, "requires_skill": 9.0, "requires_tool": 8.0, "requires_facility": 8.0, "produces_item": 8.0, "variant_location": 4.0,
    "variant_quest": 4.0, "has_action": 3.0, "variant_action": 3.0, "equips_in_slot": 2.5, "uses_combat_style": 2.0, "wiki_link": 1.0, "in_category": 0.5,
}
#: The infobox fields that hold dates.
DATE_FIELDS = ("release", "removal", "update", "removalupdate")


def _judged(spark: SparkSession, sf: str, lax: bool = False) -> DataFrame:
    return available_at(table(spark, sf, "page_nodes"), [F.col("date_added")], F.col("date_removed"), CUT, lax)


def temporal_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("node_key", "date_added", "date_removed", "reason", "kept")


def temporal_stats(spark: SparkSession, sf: str) -> DataFrame:
    modes = [_judged(spark, sf, lax).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("lax", F.lit(lax)) for lax in (False, True)]
    return modes[0].unionByName(modes[1])


def temporal_sample(spark: SparkSession, sf: str) -> DataFrame:
    return first_excluded(_judged(spark, sf), "node_key").select("node_key", "reason")


def partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "page_nodes")
    return nodes.groupBy(precision(F.col("date_added")).alias("precision")).agg(F.count(F.lit(1)).alias("n"), F.min(date_number(F.col("date_added"))).alias("first"), F.max(date_number(F.col("date_added"))).alias("last"))


def edge_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return G.merge_edges(edges_of(spark, sf), "edge_id")


def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    return G.merge_nodes(nodes_of(spark, sf), "node_key", ["kind", "label", "primary_type", "date_added", "members"])


def degrees(spark: SparkSession, sf: str) -> DataFrame:
    found = G.degrees(nodes_of(spark, sf), G.merge_edges(edges_of(spark, sf), "edge_id"))
    return found.withColumns({c: F.round(c, 3) for c in ("weighted_indegree", "weighted_outdegree")})


def edges_no_missing(spark: SparkSession, sf: str) -> DataFrame:
    nodes = nodes_of(spark, sf)
    return G.known_at_sight(edges_of(spark, sf), nodes, "built_at", "added_at").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def endpoint_join(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by relation and by the kinds of their ends, both of which must be nodes."""
    kinds = G.merge_nodes(nodes_of(spark, sf), "node_key", ["kind"]).select("id", "kind")
    edges = edges_of(spark, sf)
    both = edges.join(kinds.select(F.col("id").alias("source"), F.col("kind").alias("source_kind")), "source").join(kinds.select(F.col("id").alias("target"), F.col("kind").alias("target_kind")), "target")
    return both.groupBy("relation", "source_kind", "target_kind").agg(F.count(F.lit(1)).alias("n"))


def _ranks(spark: SparkSession, sf: str, links_only: bool = False) -> DataFrame:
    edges = edges_of(spark, sf)
    edges = edges.where((F.col("relation") == "wiki_link") & F.col("source").startswith("page:")) if links_only else edges
    return G.pagerank(nodes_of(spark, sf), edges.where(F.col("source") != F.col("target")))


def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(spark, sf).select("id", F.round("rank", 9).alias("rank"))


def pagerank_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return _ranks(spark, sf, True).select("id", F.round("rank", 9).alias("rank"))


def top_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty pages with the highest weighted in-degree."""
    pages = G.merge_nodes(nodes_of(spark, sf), "node_key", ["kind"]).where(F.col("kind") == "page").select("id")
    return degrees(spark, sf).join(pages, "id", "left_semi").select("id", "weighted_indegree").orderBy(F.desc("weighted_indegree"), "id").limit(20)


def _priority() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("relation")), F.lit(1.0))


def best_edges(spark: SparkSession, sf: str, most: int, ranks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The best edges of each source by relation, weight, rank of the target and dates; other relations are left out.

    ranks: id, rank of the pages; a target that is no page has rank 0. A weight of null or 0 counts as 1. edges: those of
    ``edges_of`` from the sources that are asked for, all if not given.
    """
    edges = G.merge_edges(edges_of(spark, sf) if edges is None else edges, "edge_id").where(F.col("relation").isin(*PRIORITY))
    ranked = edges.join(ranks.select(F.col("id").alias("target"), F.col("rank").alias("_rank")), "target", "left")
    dated = (F.col("relation") == "infobox_link") & F.coalesce("field", F.lit("")).isin(*DATE_FIELDS)
    named = F.regexp_replace("target", "^page:", "").rlike(r"^(?:\d{4}|\d{1,2} [a-z]+)\z")
    weight = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0))
    score = F.round(G.edge_score(_priority(), weight, F.coalesce("_rank", F.lit(0.0)), dated, named), 6)
    return G.top_edges(ranked, score, most, ["target", "relation", F.coalesce("field", F.lit(""))])


def top_edges_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return best_edges(spark, sf, 3, page_ranks(spark, sf)).select("source", "target", "relation", "score", "rn")


def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the pages of primary type quest over their best two edges, with their ranks."""
    seeds = nodes_of(spark, sf).where(F.col("primary_type") == "quest").select("id")
    ranks = page_ranks(spark, sf)
    best = cut(best_edges(spark, sf, 2, ranks), "best")
    return G.expand(seeds, best, 2, ranks.select("id", F.round("rank", 9).alias("rank")))


def recursive_reach(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes are within four steps of the pages of primary type quest over produces_item edges."""
    seeds = nodes_of(spark, sf).where(F.col("primary_type") == "quest").select("id")
    return G.reach(seeds, edges_of(spark, sf).where(F.col("relation") == "produces_item"), 4).groupBy("steps").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (temporal_filter, temporal_stats, temporal_sample, partial_dates, edge_dedupe, node_merge, degrees, edges_no_missing, endpoint_join, pagerank, pagerank_subgraph, top_nodes, top_edges_per_source, one_hop, recursive_reach)}

_N = r"lower(trim(regexp_replace(replace({}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')))".format
_P = r"'^((?:19|20)\d{2})(?:-(\d{1,2})(?:-(\d{1,2}))?)?'"
_PART = lambda c, i: f"TRY_CAST(nullif(regexp_extract({c}, {_P}, {i}), '') AS INTEGER)"
_D = lambda c: f"({_PART(c, 1)} * 10000 + coalesce({_PART(c, 2)}, 12) * 100 + coalesce({_PART(c, 3)}, 31))"
_REASON = lambda lax: f"CASE WHEN {_D('date_added')} IS NULL AND {not lax} THEN 'unknown_added_date' WHEN {_D('date_added')} > 20120615 THEN 'added_after_cutoff' WHEN {_D('date_removed')} <= 20120615 THEN 'removed_on_or_before_cutoff' WHEN {_D('date_added')} IS NULL THEN 'unknown_added_included' ELSE 'available_at_cutoff' END"
_GRAPH = f"""WITH nodes AS (SELECT {_N('id')} AS id, node_key, label, kind, primary_type, date_added, members, added_at FROM page_nodes UNION ALL SELECT {_N('id')}, node_key, label, kind, primary_type, date_added, members, added_at FROM core_nodes),
edges AS (SELECT edge_id, {_N('source')} AS source, {_N('target')} AS target, relation, field, weight, built_at FROM graph_edges),
merged AS (SELECT source, target, relation, field, sum(weight) AS weight, count(*) AS evidence, min(edge_id) AS first_seen FROM edges WHERE source <> target GROUP BY 1, 2, 3, 4),
kinds AS (SELECT id, CASE WHEN bool_or(kind = 'page') THEN 'page' ELSE arg_max(kind, node_key) END AS kind FROM nodes GROUP BY 1),
ends AS (SELECT target AS id, 1 AS i, weight, relation = 'wiki_link' AS link FROM merged UNION ALL SELECT source, 0, weight, relation = 'wiki_link' FROM merged),
deg AS (SELECT n.id, count(i) FILTER (i = 1) AS indegree, count(i) FILTER (i = 0) AS outdegree, round(coalesce(sum(weight) FILTER (i = 1), 0), 3) AS weighted_indegree, round(coalesce(sum(weight) FILTER (i = 0), 0), 3) AS weighted_outdegree, count(i) FILTER (i = 1 AND link) AS link_indegree, count(i) FILTER (i = 0 AND link) AS link_outdegree FROM (SELECT DISTINCT id FROM nodes) n LEFT JOIN ends e ON n.id = e.id GROUP BY 1)
"""
_RANK = lambda where: f"SELECT id, round(rank, 9) AS rank FROM ({rank_sql(where)})"
_PRIO = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " END"
_DATED = f"CASE WHEN relation = 'infobox_link' AND field IN {DATE_FIELDS} THEN 0.2 ELSE 1.0 END * CASE WHEN regexp_full_match(regexp_replace(target, '^page:', ''), '\\d{{4}}|\\d{{1,2}} [a-z]+') THEN 0.2 ELSE 1.0 END"
_BEST = f", pr AS (SELECT id AS target, rank FROM ({PAGE_RANKS})), best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target, relation, coalesce(field, '')) AS rn FROM (SELECT *, round({_PRIO} * coalesce(nullif(weight, 0), 1) * (1 + ln(1 + coalesce(rank, 0) * 1e5)) * {_DATED}, 6) AS score FROM merged LEFT JOIN pr USING (target) WHERE relation IN {tuple(PRIORITY)})) "
BEST_SQL = _GRAPH + _BEST
ORACLE = {
    "temporal_filter": f"SELECT node_key, date_added, date_removed, reason, reason LIKE 'available%' AS kept FROM (SELECT *, {_REASON(False)} AS reason FROM page_nodes)",
    "temporal_stats": " UNION ALL ".join(f"SELECT reason, count(*) AS n, {lax} AS lax FROM (SELECT {_REASON(lax)} AS reason FROM page_nodes) GROUP BY 1" for lax in (False, True)),
    "temporal_sample": f"SELECT node_key, reason FROM (SELECT node_key, reason, row_number() OVER (PARTITION BY reason ORDER BY node_key) AS rn FROM (SELECT node_key, {_REASON(False)} AS reason FROM page_nodes) WHERE reason <> 'available_at_cutoff') WHERE rn <= 50",
    "partial_dates": f"SELECT CASE WHEN date_added IS NULL OR trim(date_added) = '' THEN NULL WHEN {_PART('date_added', 3)} IS NOT NULL THEN 'day' WHEN {_PART('date_added', 2)} IS NOT NULL THEN 'month' WHEN {_PART('date_added', 1)} IS NOT NULL THEN 'year' ELSE 'raw' END AS precision, count(*) AS n, min({_D('date_added')}) AS first, max({_D('date_added')}) AS last FROM page_nodes GROUP BY 1",
    "edge_dedupe": _GRAPH + "SELECT * FROM merged",
    "node_merge": _GRAPH + "SELECT n.id, any_value(k.kind) AS kind, arg_max(label, node_key) AS label, arg_max(primary_type, node_key) AS primary_type, arg_max(date_added, node_key) AS date_added, arg_max(members, node_key) AS members, count(*) AS deliveries FROM nodes n JOIN kinds k ON n.id = k.id GROUP BY 1",
    "degrees": _GRAPH + "SELECT * FROM deg",
    "edges_no_missing": _GRAPH + "SELECT relation, count(*) AS n FROM edges e JOIN (SELECT id, min(added_at) AS seen FROM nodes GROUP BY 1) n ON e.target = n.id WHERE seen <= built_at GROUP BY 1",
    "endpoint_join": _GRAPH + "SELECT relation, a.kind AS source_kind, b.kind AS target_kind, count(*) AS n FROM edges e JOIN kinds a ON e.source = a.id JOIN kinds b ON e.target = b.id GROUP BY 1, 2, 3",
    "pagerank": _RANK(""),
    "pagerank_subgraph": _RANK("AND relation = 'wiki_link' AND source LIKE 'page:%'"),
    "top_nodes": _GRAPH + "SELECT deg.id, weighted_indegree FROM deg JOIN kinds k ON deg.id = k.id WHERE k.kind = 'page' ORDER BY 2 DESC, 1 LIMIT 20",
    "top_edges_per_source": _GRAPH + _BEST + "SELECT source, target, relation, score, rn FROM best WHERE rn <= 3",
    "one_hop": _GRAPH + _BEST + "SELECT b.source, b.target, b.relation, coalesce(round(rank, 9), 0) AS rank FROM best b WHERE rn <= 2 AND b.source IN (SELECT id FROM nodes WHERE primary_type = 'quest')",
    "recursive_reach": f"WITH RECURSIVE nodes AS (SELECT {_N('id')} AS id, primary_type FROM (SELECT id, primary_type FROM page_nodes UNION ALL SELECT id, primary_type FROM core_nodes)), e AS (SELECT DISTINCT {_N('source')} AS source, {_N('target')} AS target FROM graph_edges WHERE relation = 'produces_item' AND target IS NOT NULL), r AS (SELECT DISTINCT id, 0 AS steps FROM nodes WHERE primary_type = 'quest' UNION SELECT e.target, steps + 1 FROM r JOIN e ON r.id = e.source WHERE steps < 4) SELECT steps, count(*) AS n FROM (SELECT id, min(steps) AS steps FROM r GROUP BY 1) GROUP BY 1",
}
