"""Typed table lookups with defaults: tables of rows whose columns may be tuples or lists of tuples, maps, parameters.

A row of a table is (table_id, row_id, one column per declared column). A LIST column is an array of structs with
the fields f0, f1, ...; a plain column is such an array of one. -1 stands for no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import position

#: What a field of each type holds where nothing is given.
TYPE_DEFAULTS = {"string": "", "boolean": 0, "int": -1}


@dataclass(frozen=True)
class TableSpec:
    """Column name to (field types, indexed, default tuple or None)."""

    table_id: int
    columns: dict[str, tuple[tuple[str, ...], bool, tuple | None]] = field(default_factory=dict)


def list_all(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """All rows of one table in row order, with ``ord`` from 0."""
    return _numbered(rows.where(F.col("table_id") == spec.table_id).select("table_id", "row_id"), ["row_id"])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Cursor positions from 0 in the order of the columns, by range partitions: a found set may be a whole table."""
    return position(rows, [(c, False) for c in order], "ord").withColumn("ord", F.col("ord") - 1)


def find(rows: DataFrame, spec: TableSpec, column: str, value: Any, at: int = 0) -> DataFrame:
    """Rows whose tuple field ``at`` of ``column`` holds the value; a value that a list holds twice finds its row twice.

    A column that is not indexed finds nothing.
    """
    if not spec.columns[column][1]:
        return _numbered(rows.where(F.lit(False)).select("table_id", "row_id"), ["row_id"])
    flat = rows.where(F.col("table_id") == spec.table_id).select("table_id", "row_id", F.posexplode(column).alias("_i", "_e"))
    return _numbered(flat.where(F.col("_e")[f"f{at}"] == value), ["row_id", "_i"]).select("table_id", "row_id", "ord")


def refine(found: DataFrame, again: DataFrame) -> DataFrame:
    """The found rows that a second lookup finds too, in their order; repeated rows stay."""
    kept = found.join(again.select("table_id", "row_id").distinct(), ["table_id", "row_id"], "left_semi")
    return _numbered(kept.withColumnRenamed("ord", "_was"), ["_was"]).drop("_was")


def get_field(spec: TableSpec, column: str, index: Column, at: int = 0) -> Column:
    """Field ``at`` of the tuple at ``index``; else the table's default, else the type's. Another table's row gives that too."""
    types, _, default = spec.columns[column]
    fallback = default[at] if default is not None else TYPE_DEFAULTS[types[at]]
    own = F.when(F.col("table_id") == spec.table_id, F.try_element_at(F.col(column), index.cast("int") + 1)[f"f{at}"])
    return F.coalesce(own, F.lit(fallback))


def field_count(spec: TableSpec, column: str) -> Column:
    """Number of tuples; 0 for a row of another table."""
    return F.when(F.col("table_id") == spec.table_id, F.coalesce(F.size(F.col(column)), F.lit(0))).otherwise(0)


def count_of(found: DataFrame) -> DataFrame:
    """The number of rows found, as one row: what a counting lookup gives beside its rows."""
    return found.agg(F.count(F.lit(1)).alias("found"))


def enum_count(entries: dict) -> int:
    """The number of entries of a typed map; its default is none of them."""
    return len(entries)


def by_index(found: DataFrame, index: int) -> DataFrame:
    """row_id at a cursor position, -1 past the end: always one row."""
    return found.where(F.col("ord") == index).agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("row_id"))


def enum_value(entries: dict, key: Column, default: Any) -> Column:
    """A typed map with a default; a missing key and a null key give the default."""
    pairs = F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def param(params: Column, key: int, default: Any) -> Column:
    return F.coalesce(F.try_element_at(params, F.lit(key)), F.lit(default))
