"""Problem 5: the category and template names of raw_pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normal_name
from quern.llm.terms import term_frequencies, with_mark
from quern.runtime import table


def term(name: Column) -> Column:
    return F.trim(F.regexp_replace(normal_name(name), "^(category|template):", ""))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "raw_pages")
    rows = pages.select(F.transform(F.col("categories.category"), term).alias("categories"), F.transform(F.col("templates.title"), term).alias("templates"))
    return with_mark(term_frequencies(rows, ["categories", "templates"]), pages.count())


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).where(F.col("mark") != "kept").select("field", "term")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf)


QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms}

_T = r"trim(regexp_replace(lower(trim(regexp_replace(replace({}, '_', ' '), '[\s\p{{Z}}]+', ' ', 'g'))), '^(category|template):', ''))".format
_COUNTED = f"""
WITH terms AS (
  SELECT 'categories' AS field, raw_id, {_T('u.category')} AS term FROM (SELECT raw_id, unnest(categories) AS u FROM raw_pages)
  UNION ALL SELECT 'templates', raw_id, {_T('u.title')} FROM (SELECT raw_id, unnest(templates) AS u FROM raw_pages)
), counted AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT raw_id) AS n_rows FROM terms WHERE term IS NOT NULL GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN n_rows <= 2 THEN 'rare' WHEN n_rows > 0.25 * (SELECT count(*) FROM raw_pages) THEN 'common' ELSE 'kept' END AS mark FROM counted)
"""
ORACLE = {
    "p5_found": _COUNTED + "SELECT field, term FROM marked WHERE mark <> 'kept'",
    "p5_terms": _COUNTED + "SELECT field, term, row_number() OVER (ORDER BY field, term) - 1 AS term_id, occurrences, n_rows, mark FROM marked",
}
