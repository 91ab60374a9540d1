"""Which records were there at a cutoff, from partial dates with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dates import date_number

CUTOFF = "2004-09-07"


def available_at(rows: DataFrame, added: list[Column], removed: Column, cutoff: str = CUTOFF, lax: bool = False) -> DataFrame:
    """Adds ``reason`` and ``kept``. The first of the ``added`` dates that reads as a date counts.

    In this order: no date of addition (kept only if lax), added after the cutoff, removed at or before it, kept.
    """
    at = F.coalesce(*[date_number(a) for a in added])
    line = date_number(F.lit(cutoff))
    gone = date_number(removed)
    reason = F.when(at.isNull() & F.lit(not lax), "unknown_added_date").when(at > line, "added_after_cutoff").when(gone <= line, "removed_on_or_before_cutoff").when(at.isNull(), "unknown_added_included").otherwise("available_at_cutoff")
    return rows.withColumn("reason", reason).withColumn("kept", F.col("reason").isin("available_at_cutoff", "unknown_added_included"))


def first_excluded(judged: DataFrame, order: str, n: int = 50) -> DataFrame:
    """The first n excluded rows of each reason, by ``order``."""
    window = Window.partitionBy("reason").orderBy(order)
    return judged.where(~F.col("kept")).withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)
