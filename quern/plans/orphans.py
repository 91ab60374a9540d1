"""Problem 4: orphan references of graph_edges, raw_pages and structured_records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normal_name
from quern.operators.references import count_by_period, orphan_references
from quern.runtime import table


def _references(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "graph_edges").where(F.col("target").isNotNull()).select(F.lit("graph_edges").alias("tbl"), F.col("edge_id").alias("ref_id"), F.lit(-1).alias("link_ord"), normal_name(F.col("target")).alias("key"), F.col("built_at").alias("at"))
    # Zipped from two leaves, so that only these are read from the files.
    both = F.arrays_zip(F.col("links.ns").alias("ns"), F.col("links.title").alias("title"))
    links = table(spark, sf, "raw_pages").select("raw_id", "fetched_at", F.posexplode(both).alias("link_ord", "link"))
    named = links.where((F.col("link.ns") == 0) & F.col("link.title").isNotNull())
    title = normal_name(F.substring_index("link.title", "#", 1))
    pages = named.select(F.lit("raw_pages").alias("tbl"), F.col("raw_id").alias("ref_id"), "link_ord", F.concat(F.lit("page:"), title).alias("key"), F.col("fetched_at").alias("at"))
    return edges.unionByName(pages)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    cols = [normal_name(F.col("id")).alias("id"), "added_at", "removed_at"]
    return table(spark, sf, "page_nodes").select(*cols).unionByName(table(spark, sf, "core_nodes").select(*cols))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(_references(spark, sf), _nodes(spark, sf), [("key", "id")], "simple", "at", ("added_at", "removed_at"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("tbl", "ref_id", "link_ord")


def p4_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return count_by_period(_orphans(spark, sf), "tbl", "at")


def p4_record_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Records and fetches whose (pageid, title) names no page: a composite key of which either part may be null."""
    title = normal_name(F.col("title")).alias("title")
    records = table(spark, sf, "structured_records").select(F.lit("structured_records").alias("tbl"), F.col("record_id").alias("ref_id"), "pageid", title)
    fetches = table(spark, sf, "raw_pages").select(F.lit("raw_pages").alias("tbl"), F.col("raw_id").alias("ref_id"), "pageid", title)
    nodes = table(spark, sf, "page_nodes").select("pageid", title)
    found = orphan_references(records.unionByName(fetches), nodes, [("pageid", "pageid"), ("title", "title")], "partial")
    return found.select("tbl", "ref_id", "pageid", "title")


QUERIES = {"p4_found": p4_found, "p4_by_month": p4_by_month, "p4_record_pages": p4_record_pages}

_NORM = r"lower(trim(regexp_replace(replace({}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')))"
_N = _NORM.format
_REFS = f"""
WITH refs AS (
  SELECT 'graph_edges' AS tbl, edge_id AS ref_id, -1 AS link_ord, {_N('target')} AS key, built_at AS seen FROM graph_edges WHERE target IS NOT NULL
  UNION ALL
  SELECT 'raw_pages', raw_id, CAST(ord - 1 AS INTEGER), 'page:' || {_N("split_part(l.title, '#', 1)")}, fetched_at
  FROM (SELECT raw_id, fetched_at, unnest(links) AS l, generate_subscripts(links, 1) AS ord FROM raw_pages) x
  WHERE l.ns = 0 AND l.title IS NOT NULL
), nodes AS (
  SELECT {_N('id')} AS id, added_at, removed_at FROM page_nodes UNION ALL SELECT {_N('id')}, added_at, removed_at FROM core_nodes
), orphans AS (
  SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = r.key AND n.added_at <= r.seen AND (n.removed_at IS NULL OR n.removed_at > r.seen))
)
"""
ORACLE = {
    "p4_found": _REFS + "SELECT tbl, ref_id, link_ord FROM orphans",
    "p4_by_month": _REFS + "SELECT tbl, strftime(seen, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY 1, 2",
    "p4_record_pages": f"""
WITH refs AS (
  SELECT 'structured_records' AS tbl, record_id AS ref_id, pageid, {_N('title')} AS title FROM structured_records
  UNION ALL SELECT 'raw_pages', raw_id, pageid, {_N('title')} FROM raw_pages
), nodes AS (SELECT DISTINCT pageid, {_N('title')} AS title FROM page_nodes)
SELECT * FROM refs r WHERE (pageid IS NOT NULL OR title IS NOT NULL)
AND NOT EXISTS (SELECT 1 FROM nodes n WHERE (r.pageid IS NULL OR n.pageid = r.pageid) AND (r.title IS NULL OR n.title = r.title))
""",
}
