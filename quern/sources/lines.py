"""JSON lines and comma-separated values, in and out, with the rows that do not parse accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_corrupt_record"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the text files at a path: body and the file it is from."""
    return spark.read.text(path).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"))


def parse_json_lines(lines: DataFrame, body: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Adds ``record`` (null where the line does not parse) and ``state``: blank, broken or parsed.

    strict: a line that does not parse raises when it is read. The schema is declared and never inferred.
    """
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    made = lines.withColumn("record", F.from_json(F.col(body), wide, {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    blank = F.col(body).isNull() | (F.trim(F.col(body)) == "")
    state = F.when(blank, "blank").when(F.col(f"record.{BROKEN}").isNotNull() | F.col("record").isNull(), "broken").otherwise("parsed")
    return made.withColumn("state", state).withColumn("record", F.when(F.col("state") == "parsed", F.col("record").dropFields(BROKEN)))


def counters(parsed: DataFrame, by: list[str], blank_counts: bool = True) -> DataFrame:
    """Lines read, parsed and broken; whether blank lines count as read differs between the tools and is a parameter."""
    read = F.count(F.lit(1)) if blank_counts else F.count_if(F.col("state") != "blank")
    return parsed.groupBy(*by).agg(read.alias("read"), F.count_if(F.col("state") == "parsed").alias("parsed"), F.count_if(F.col("state") == "broken").alias("errors"))


def _text(column: str, kind: T.DataType, joined: bool) -> Column:
    c = F.col(f"`{column}`")
    if isinstance(kind, T.ArrayType):
        return F.array_join(c.cast("array<string>"), "|") if joined else F.to_json(c)
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def csv_always_quoted(rows: DataFrame) -> DataFrame:
    """One column ``line``: every value in quotes, arrays joined by ``|``, null as an empty field without quotes."""
    cells = [F.coalesce(F.concat(F.lit('"'), F.replace(_text(f.name, f.dataType, True), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for f in rows.schema.fields]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def csv_quoted_where_needed(rows: DataFrame) -> DataFrame:
    """One column ``line``: quotes only around values with a quote, a comma or a line break; null as an empty field."""
    cells = []
    for f in rows.schema.fields:
        text = F.coalesce(_text(f.name, f.dataType, False), F.lit(""))
        cells.append(F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def write_json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def read_csv_cells(lines: DataFrame, body: str, least: int) -> DataFrame:
    """Adds ``cells``: the fields of a line split at commas; comments (``//``), blank and short lines are left out."""
    cells = F.transform(F.split(F.col(body), ","), lambda c: F.trim(c))
    kept = lines.where(F.col(body).isNotNull() & ~F.ltrim(F.col(body)).startswith("//"))
    return kept.withColumn("cells", cells).where(F.size("cells") >= least)


def split_quoted(line: Column) -> Column:
    """Fields of a line in which a quote switches the meaning of commas on and off; a doubled quote has no meaning."""
    parts = F.split(line, '"')
    # Odd parts were inside quotes: their commas are hidden while the line is split.
    hidden = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(","), F.lit("\u0001"))).otherwise(p))
    return F.transform(F.split(F.array_join(hidden, ""), ","), lambda c: F.replace(c, F.lit("\u0001"), F.lit(",")))


def zone_set(lines: DataFrame, body: str) -> DataFrame:
    """level, zx, zz: the distinct zones, eight squares wide, of lines ``level,x,z``; the header, comments and lines that
    are no three numbers name none."""
    cells = F.split(F.regexp_replace(F.col(body), r"\s", ""), ",")
    number = lambda i: F.try_element_at(cells, F.lit(i)).try_cast("int")
    read = lines.select(number(1).alias("level"), F.floor(number(2) / 8).alias("zx"), F.floor(number(3) / 8).alias("zz"))
    return read.na.drop().distinct()


def without_header(lines: DataFrame, order: str) -> DataFrame:
    """All lines but the first in the order of ``order``; the first is found by a partial minimum."""
    first = lines.agg(F.min(order).alias("_first"))
    return lines.join(F.broadcast(first)).where(F.col(order) > F.col("_first")).drop("_first")  # one row


def table_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """ord, line: a small result as a Markdown table: the head, the rule and one line per row, in order."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    top = rows.sparkSession.createDataFrame([(i - 2, x) for i, x in enumerate(head)], "ord bigint, line string")
    from quern.operators.relational import position

    body = position(rows.select(*columns), [(c, False) for c in order], "ord").select((F.col("ord") - 1).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    return top.unionByName(body)


def write_json_document(rows: DataFrame, path: str) -> None:
    """A result of one row as one JSON document in place of what was at ``path``; any other number of rows is an error."""
    few = rows.limit(2).count()
    if few != 1:
        raise ValueError("a document is one row")
    rows.coalesce(1).write.mode("overwrite").json(path)
