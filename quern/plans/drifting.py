"""Problem 2: the line files of structured records and of transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.schema_drift import consistent, drift
from quern.runtime import table

TABLES = ("structured_lines", "transition_lines")
KEEP = ["line_id", "feed", "file_name", "file_seq", "arrived_at", "line_no", "rec_key"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables in one pass: a feed of either is a feed of its own."""
    parts = [table(spark, sf, t).select(F.concat_ws("/", F.lit(t), "feed").alias("feed"), "file_seq", "rec_key", "line_no", "body") for t in TABLES]
    found = drift(parts[0].unionByName(parts[1]))
    tbl = F.substring_index("feed", "/", 1)
    return found.select(tbl.alias("tbl"), F.expr("CASE WHEN instr(feed, '/') > 0 THEN substring(feed, instr(feed, '/') + 1) END").alias("feed"), "file_seq", "change", "field", "new_field")


def p2_structured_table(spark: SparkSession, sf: str) -> DataFrame:
    return consistent(table(spark, sf, "structured_lines"), KEEP)


def p2_transition_table(spark: SparkSession, sf: str) -> DataFrame:
    return consistent(table(spark, sf, "transition_lines"), KEEP)


QUERIES = {"p2_found": p2_found, "p2_structured_table": p2_structured_table, "p2_transition_table": p2_transition_table}


def _changes(tbl: str) -> str:
    """SQL for the report of one table. Where several new fields hold the values of a lost one it takes the first by name."""
    return f"""SELECT '{tbl}' AS tbl, * FROM (
WITH l AS (SELECT feed, file_seq, line_no, rec_key, body FROM {tbl} WHERE json_valid(body)),
n AS (SELECT feed, file_seq, count(*) AS lines FROM l GROUP BY 1, 2),
v AS (SELECT feed, file_seq, line_no, rec_key, replace(substring(t.fullkey, 3), '"', '') AS path, CAST(json(t.value) AS VARCHAR) AS value,
  CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS type
  FROM l, json_tree(l.body) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND NOT contains(t.fullkey, '[')),
c AS (SELECT feed, file_seq, path, type, count(*) AS k FROM v GROUP BY ALL),
f AS (SELECT feed, file_seq, path, arg_max(type, k) AS type FROM c JOIN n USING (feed, file_seq) GROUP BY feed, file_seq, path, lines HAVING sum(k) * 5 >= lines),
s AS (SELECT feed, file_seq, lag(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS prev FROM n),
a AS (SELECT s.feed, s.file_seq, s.prev, path, type FROM s JOIN f ON f.feed = s.feed AND f.file_seq = s.prev),
b AS (SELECT s.feed, s.file_seq, path, type FROM s JOIN f ON f.feed = s.feed AND f.file_seq = s.file_seq WHERE s.prev IS NOT NULL),
gone AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.feed = a.feed AND b.file_seq = a.file_seq AND b.path = a.path)),
fresh AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.feed = a.feed AND b.file_seq = a.file_seq AND b.path = a.path)),
h AS (SELECT feed, file_seq, path, rec_key, arg_min(value, line_no) AS value FROM v GROUP BY ALL),
r AS (SELECT g.feed, g.file_seq, g.path AS old, w.path AS new FROM gone g JOIN fresh w ON g.feed = w.feed AND g.file_seq = w.file_seq
  JOIN h x ON x.feed = g.feed AND x.file_seq = g.prev AND x.path = g.path JOIN h y ON y.feed = w.feed AND y.file_seq = w.file_seq AND y.path = w.path AND y.rec_key = x.rec_key
  GROUP BY ALL HAVING count(*) FILTER (x.value = y.value) * 5 >= count(*) * 4),
best AS (SELECT feed, file_seq, old, min(new) AS new FROM r GROUP BY ALL)
SELECT a.feed, a.file_seq, 'type_changed' AS change, a.path AS field, '' AS new_field FROM a JOIN b ON a.feed = b.feed AND a.file_seq = b.file_seq AND a.path = b.path WHERE a.type <> b.type
UNION ALL SELECT g.feed, g.file_seq, CASE WHEN new IS NULL THEN 'removed' ELSE 'renamed' END, g.path, coalesce(new, '') FROM gone g LEFT JOIN best ON best.feed = g.feed AND best.file_seq = g.file_seq AND best.old = g.path
UNION ALL SELECT w.feed, w.file_seq, 'added', w.path, '' FROM fresh w WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.feed = w.feed AND best.file_seq = w.file_seq AND best.new = w.path))"""


ORACLE: dict[str, str] = {"p2_found": " UNION ALL ".join(map(_changes, TABLES))}
