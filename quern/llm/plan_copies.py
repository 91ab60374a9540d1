"""Problem 1: copies in raw_pages and structured_records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.copies import CopyClasses, keyed_records
from quern.runtime import table

SPECS = {
    "raw_pages": ("raw_id", ["title", "requested_title"], ["properties"]),
    "structured_records": ("record_id", ["normalized_title", "primary_type"], []),
}


def _classes(spark: SparkSession, sf: str, name: str) -> CopyClasses:
    return CopyClasses(keyed_records(table(spark, sf, name), *SPECS[name]), label=f"copies-{name}")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name in SPECS:
        rows = _classes(spark, sf, name).members().where(F.col("id") != F.col("first_id"))
        parts.append(rows.select(F.lit(name).alias("tbl"), "first_id", F.col("id").alias("copy_id")))
    return parts[0].unionByName(parts[1])


def p1_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    parts = [_classes(spark, sf, name).collapsed().select(F.lit(name).alias("tbl"), "first_id", "copies") for name in SPECS]
    return parts[0].unionByName(parts[1])


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}

_T = r"lower(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{Nd}}]+', '', 'g'))".format
_KEYED = f"""
WITH keyed AS (
  SELECT 'raw_pages' AS tbl, raw_id AS id, {_T('title')} AS a, {_T('requested_title')} AS b,
    list_sort(list_transform(json_keys(properties), lambda k: k || '=' || json_extract(properties, '$.' || k))) AS p FROM raw_pages
  UNION ALL SELECT 'structured_records', record_id, {_T('normalized_title')}, {_T('primary_type')}, [] FROM structured_records
), classes AS (SELECT tbl, id, min(id) OVER w AS first_id, count(*) OVER w AS copies FROM keyed WINDOW w AS (PARTITION BY tbl, a, b, p))
"""
ORACLE = {
    "p1_found": _KEYED + "SELECT tbl, first_id, id AS copy_id FROM classes WHERE id <> first_id",
    "p1_collapsed": _KEYED + "SELECT tbl, first_id, copies FROM classes WHERE id = first_id",
}
