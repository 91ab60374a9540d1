"""Problem 8: statistics of every text in documents, and those that are not natural prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.quality import PASSAGE_RATIOS, STATISTICS, common_words, document_statistics, flagged, language, measured, passage_sketch, running_shares, scales, scored, sketch, with_words
from quern.runtime import cut, table

#: All tails that are reported, as robust z-scores.
REPORTED = {
    "common_share": (-3.0, 3.0), "symbol_share": (None, 3.0), "digit_share": (None, 3.0), "mean_word": (-3.0, 3.0), "line_end_share": (-3.0, None), "mean_line": (-3.0, None),
}


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", language(F.col("lang")).alias("lang"), "text")
    return with_words(docs, common_words(docs.select("lang", "text")))


def _running(spark: SparkSession, sf: str) -> DataFrame:
    passages = cut(measured(_documents(spark, sf)), "passages")
    return running_shares(passages, scales(passage_sketch(passages), PASSAGE_RATIOS))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of which more than half of the characters lie in passages in a tail of their language."""
    return _running(spark, sf).where(F.col("running_share") < 0.5).select("doc_id")


def p8_running(spark: SparkSession, sf: str) -> DataFrame:
    return _running(spark, sf)


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return document_statistics(_documents(spark, sf))


def p8_tails(spark: SparkSession, sf: str) -> DataFrame:
    stats = cut(document_statistics(_documents(spark, sf)), "statistics")
    rows = flagged(scored(stats, scales(sketch(stats, {s: F.col(s) for s in STATISTICS}))), REPORTED).select("lang", F.explode("tails").alias("tail"))
    return rows.groupBy("lang", "tail").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p8_found": p8_found, "p8_running": p8_running, "p8_statistics": p8_statistics, "p8_tails": p8_tails}

_STATS = r"""
WITH docs AS (SELECT doc_id, coalesce(lower(trim(lang)), '') AS lang, coalesce(text, '') AS text FROM documents),
rows_ AS (SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[^\p{L} ]+')) AS x FROM docs),
used AS (SELECT DISTINCT doc_id, lang, unnest(string_split_regex(x, ' +')) AS word FROM rows_ WHERE regexp_matches(x, '^ *\p{L}+ +\p{L}+ +\p{L}+ +\p{L}+ +\p{L}')),
ranked AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rn FROM used WHERE word <> '' GROUP BY 1, 2),
lists AS (SELECT lang, word FROM ranked WHERE rn <= 60),
frequent AS (SELECT lang FROM docs WHERE lang <> '' GROUP BY 1 HAVING count(*) >= 0.001 * (SELECT count(*) FROM docs)),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS word FROM docs),
sizes AS (SELECT doc_id, count(*) AS k FROM words GROUP BY 1),
votes AS (SELECT doc_id, l.lang, count(*) AS v FROM words JOIN lists l USING (word) SEMI JOIN frequent USING (lang) SEMI JOIN (SELECT doc_id FROM docs WHERE lang = '') USING (doc_id) GROUP BY 1, 2),
guess AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, lang) AS rn FROM votes) WHERE rn = 1),
spoken AS (SELECT d.doc_id, coalesce(g.lang, d.lang) AS lang, d.text FROM docs d LEFT JOIN guess g USING (doc_id)),
known AS (SELECT doc_id, count(*) AS c FROM words JOIN spoken USING (doc_id) JOIN lists USING (lang, word) GROUP BY 1),
stats AS (SELECT doc_id, lang, n_chars, n_words, solid / nullif(n_words, 0) AS mean_word, (solid - letters - digits) / nullif(n_chars, 0) AS symbol_share, digits / nullif(n_chars, 0) AS digit_share,
  ends / nullif(lines, 0) AS line_end_share, n_chars / nullif(lines, 0) AS mean_line, coalesce(c, 0) / k AS common_share
  FROM (SELECT doc_id, lang, length(text) AS n_chars, len(regexp_extract_all(text, '\S+')) AS n_words, len(regexp_extract_all(text, '\S')) AS solid, len(regexp_extract_all(text, '\p{L}')) AS letters,
    len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[^\n]*\S[^\n]*')) AS lines, len(regexp_extract_all(text || chr(10), '[.!?…:;"”»)][ \t\r]*\n')) AS ends FROM spoken)
  LEFT JOIN sizes USING (doc_id) LEFT JOIN known USING (doc_id))
"""
_TAILS = " UNION ALL ".join(
    f"SELECT lang, '{s}-{side}' AS tail FROM z WHERE statistic = '{s}' AND z {'<=' if side == 'low' else '>='} {bound}"
    for s, bounds in REPORTED.items() for side, bound in zip(("low", "high"), bounds, strict=True) if bound is not None
)
ORACLE: dict[str, str] = {
    "p8_statistics": _STATS + "SELECT * FROM stats",
    "p8_tails": _STATS + f""", v AS (UNPIVOT (SELECT lang, {', '.join(f'CAST({s} AS DOUBLE) AS {s}' for s in STATISTICS)} FROM stats) ON {', '.join(STATISTICS)} INTO NAME statistic VALUE v),
b AS (SELECT lang, statistic, CASE WHEN v < 1e-4 THEN 0 ELSE CAST(floor(ln(v / 1e-4) / ln(1.01)) AS INTEGER) + 1 END AS bucket, count(*) AS n FROM v GROUP BY ALL),
m AS (SELECT *, CASE WHEN bucket = 0 THEN 0.0 ELSE exp((bucket - 0.5) * ln(1.01)) * 1e-4 END AS mid FROM b),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang, statistic) AS total, sum(n) OVER (PARTITION BY lang, statistic ORDER BY bucket) AS upto FROM m),
d AS (SELECT *, min(CASE WHEN upto * 2 >= total THEN mid END) OVER (PARTITION BY lang, statistic) AS median FROM r),
e AS (SELECT *, abs(mid - median) AS away, sum(n) OVER (PARTITION BY lang, statistic ORDER BY abs(mid - median) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS near FROM d),
s AS (SELECT lang, statistic, max(median) AS median, min(CASE WHEN near * 2 >= total THEN away END) AS mad FROM e GROUP BY ALL),
z AS (SELECT v.lang, v.statistic, (v - median) / greatest(mad * 1.4826, CASE v.statistic WHEN 'n_chars' THEN 50.0 WHEN 'n_words' THEN 10.0 WHEN 'mean_word' THEN 0.2 WHEN 'mean_line' THEN 5.0 ELSE 0.02 END) AS z FROM v JOIN s USING (lang, statistic))
SELECT lang, tail, count(*) AS documents FROM ({_TAILS}) GROUP BY 1, 2""",
}
