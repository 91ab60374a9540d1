"""Lines in and out: JSON lines with accounting, comma-separated values, grouped counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.runtime import table
from quern.sources import lines as L

RECORD = T.StructType([T.StructField("source", T.StringType()), T.StructField("entity", T.StructType([T.StructField("title", T.StringType()), T.StructField("tradeable", T.StringType())]))])


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return L.parse_json_lines(table(spark, sf, "structured_lines"), "body", RECORD)


def jsonl_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.counters(_parsed(spark, sf), ["feed"])


def jsonl_counts_no_blank(spark: SparkSession, sf: str) -> DataFrame:
    return L.counters(_parsed(spark, sf), ["feed"], blank_counts=False)


def jsonl_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The parsed lines of one key in file order."""
    rows = _parsed(spark, sf).where((F.col("state") == "parsed") & (F.col("rec_key") == "800000"))
    return rows.select("file_seq", "line_no", F.col("record.entity.title").alias("title")).orderBy("file_seq", "line_no")


def csv_quoted(spark: SparkSession, sf: str) -> DataFrame:
    return L.csv_always_quoted(table(spark, sf, "page_nodes").select("node_key", "label", "types", "date_removed"))


def csv_plain(spark: SparkSession, sf: str) -> DataFrame:
    return L.csv_quoted_where_needed(table(spark, sf, "page_nodes").select("node_key", "label", "date_removed"))


def csv_split(spark: SparkSession, sf: str) -> DataFrame:
    made = L.csv_quoted_where_needed(table(spark, sf, "page_nodes").select("label", "node_key"))
    cells = L.split_quoted(F.col("line"))
    return made.select(cells[0].alias("label"), cells[1].alias("node_key"))


def group_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of one run: nodes by kind and edges by relation."""
    nodes = table(spark, sf, "page_nodes").unionByName(table(spark, sf, "core_nodes")).groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes_by_kind").alias("counter"), "name", "n")
    edges = table(spark, sf, "graph_edges").groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges_by_relation").alias("counter"), "name", "n")
    return nodes.unionByName(edges)


QUERIES = {f.__name__: f for f in (jsonl_counts, jsonl_counts_no_blank, jsonl_by_key, csv_quoted, csv_plain, csv_split, group_counters)}
_Q = "coalesce('\"' || replace({}, '\"', '\"\"') || '\"', '')".format
_PLAIN = "CASE WHEN regexp_matches({0}, '[\",\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE coalesce({0}, '') END".format
ORACLE = {
    "jsonl_counts": "SELECT feed, count(*) AS read, count(*) FILTER (json_valid(body)) AS parsed, count(*) FILTER (trim(body) <> '' AND NOT json_valid(body)) AS errors FROM structured_lines GROUP BY 1",
    "jsonl_counts_no_blank": "SELECT feed, count(*) FILTER (trim(body) <> '') AS read, count(*) FILTER (json_valid(body)) AS parsed, count(*) FILTER (trim(body) <> '' AND NOT json_valid(body)) AS errors FROM structured_lines GROUP BY 1",
    "jsonl_by_key": "SELECT file_seq, line_no, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.entity.title') END AS title FROM structured_lines WHERE rec_key = '800000' AND json_valid(body) ORDER BY 1, 2",
    "csv_quoted": f"SELECT {_Q('node_key::VARCHAR')} || ',' || {_Q('label')} || ',' || {_Q('''array_to_string(types, '|')''')} || ',' || {_Q('date_removed')} AS line FROM page_nodes",
    "csv_plain": f"SELECT node_key || ',' || {_PLAIN('label')} || ',' || {_PLAIN('date_removed')} AS line FROM page_nodes",
    "csv_split": "SELECT coalesce(label, '') AS label, node_key::VARCHAR AS node_key FROM page_nodes",
    "group_counters": "SELECT 'nodes_by_kind' AS counter, kind AS name, count(*) AS n FROM (SELECT kind FROM page_nodes UNION ALL SELECT kind FROM core_nodes) GROUP BY 2 UNION ALL SELECT 'edges_by_relation', relation, count(*) FROM graph_edges GROUP BY 2",
}
