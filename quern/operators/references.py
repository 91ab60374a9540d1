"""References to records that do not exist: orphan detection over composite keys with partial nulls.

The references are grouped by null mask (which of the key columns are null). Each mask is anti-joined with the
referred-to table on its own non-null columns, under a declared match semantics:

* ``simple``: a reference with any null key column refers to nothing and is never an orphan;
* ``partial``: the non-null columns must match; a reference whose columns are all null refers to nothing;
* ``full``: all columns null refers to nothing; some but not all null is always an orphan.

The mask is a column of the join key: a reference has the one of its nulls, and a target row stands once under each
mask that can occur, with its other columns blanked. So all masks take one join, and each table is read the same few
times however many key columns there are.

With ``at`` and ``valid``, a target row counts only if ``valid[0] <= at`` and ``valid[1]`` is null or ``> at``. A
reference with a null time is matched on its key alone; a target without a start was always there.

Hot reference keys are found exactly, and their references are spread over salts; the few target rows of a hot
key are repeated once per salt. No side is broadcast but the hot keys, of which there are at most ``max_hot``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import hot_keys, salts_for

SEMANTICS = ("simple", "partial", "full")


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    key: list[tuple[str, str]],
    match: str = "simple",
    at: str | None = None,
    valid: tuple[str, str] | None = None,
    max_hot: int = 2000,
    min_hot_rows: int = 1000,
    rows_per_salt: int = 100_000,
) -> DataFrame:
    """The rows of ``refs`` that refer to no row of ``targets``; key: pairs (column of refs, column of targets).

    Repeated references are all kept, as are all columns of ``refs``, whatever the columns of ``targets`` are
    called. Empty tables: no references give no orphans; without targets every reference is an orphan.
    """
    if match not in SEMANTICS:
        raise ValueError(f"match must be one of {SEMANTICS}")
    if (at is None) != (valid is None):
        raise ValueError("at and valid go together")
    n = len(key)
    every = 2**n - 1
    there = [F.col(f"`{r}`").isNotNull() for r, _ in key]
    mask = reduce(lambda a, b: a + b, [F.when(x, F.lit(2**i)).otherwise(F.lit(0)) for i, x in enumerate(there)])
    row = F.struct(*[F.col(f"`{c}`") for c in refs.columns]).alias("_row")
    keyed = refs.select(row, mask.alias("_mask"), *[F.col(f"`{r}`").alias(f"_k{i}") for i, (r, _) in enumerate(key)], *([F.col(f"`{at}`").alias("_at")] if at else []))
    asked = keyed.where(F.col("_mask") == every) if match != "partial" else keyed.where(F.col("_mask") > 0)
    masks = [every] if match != "partial" else list(range(1, every + 1))

    ends = [F.col(f"`{valid[0]}`").alias("_from"), F.col(f"`{valid[1]}`").alias("_to")] if valid else []
    slim = targets.select(*[F.col(f"`{t}`").alias(f"_t{i}") for i, (_, t) in enumerate(key)], *ends)
    has = lambda m: reduce(lambda a, b: a & b, [F.col(f"_t{i}").isNotNull() for i in range(n) if m >> i & 1])
    under = F.array_compact(F.array(*[F.when(has(m), F.struct(F.lit(m).alias("_mask"), *[(F.col(f"_t{i}") if m >> i & 1 else F.lit(None).cast(targets.schema[key[i][1]].dataType)).alias(f"_k{i}") for i in range(n)])) for m in masks]))
    ks = ["_mask", *[f"_k{i}" for i in range(n)]]
    offered = slim.select(F.explode(under).alias("_u"), *(["_from", "_to"] if valid else [])).select("_u.*", *(["_from", "_to"] if valid else []))
    if at:
        # One row per key and start: a later end covers an earlier one, and no start means always there.
        end = F.when(F.max(F.col("_to").isNull()), F.lit(None)).otherwise(F.max("_to"))
        offered = offered.groupBy(*ks, "_from").agg(end.alias("_to"))
    else:
        offered = offered.distinct()
    hot = hot_keys(asked, ks, max_hot, min_hot_rows).select(*[F.col(k).alias(f"_h{k}") for k in ks], salts_for(F.col("n_rows"), rows_per_salt).alias("_salts"))
    # Under one mask no key column is null; under several the blanked ones are null on both sides.
    same = lambda a, b: a == b if len(masks) == 1 else a.eqNullSafe(b)
    with_salts = lambda df: df.join(F.broadcast(hot), [same(F.col(k), F.col(f"_h{k}")) for k in ks], "left").drop(*[f"_h{k}" for k in ks])
    spread = F.pmod(F.xxhash64("_row"), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    asked = with_salts(asked).withColumn("_salt", spread).drop("_salts")
    salted = with_salts(offered).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    cond: list[Column] = [same(asked[k], salted[k]) for k in ks] + [asked["_salt"] == salted["_salt"]]
    if at:
        begun = salted["_from"].isNull() | (salted["_from"] <= asked["_at"])
        cond.append(asked["_at"].isNull() | (begun & (salted["_to"].isNull() | (salted["_to"] > asked["_at"]))))
    orphans = asked.join(salted, cond, "left_anti").select("_row.*")
    if match == "full" and n > 1:
        orphans = orphans.unionByName(keyed.where((F.col("_mask") > 0) & (F.col("_mask") < every)).select("_row.*"))
    return orphans


def count_by_period(orphans: DataFrame, table_col: str, at: str) -> DataFrame:
    """Orphans per table and month; a null time gives a null month."""
    month = F.date_format(F.trunc(F.col(f"`{at}`"), "month"), "yyyy-MM")
    return orphans.groupBy(F.col(f"`{table_col}`").alias("tbl"), month.alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
