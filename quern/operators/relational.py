"""Leaderboards, threshold filters, semi and anti joins, upserts: relational operators as DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import running_total


def better(level: str, time: str, at_level: Column, at_time: Column) -> Column:
    """Strictly better than a given row: a higher level, or the same in less time."""
    return (F.col(level) > at_level) | ((F.col(level) == at_level) & (F.col(time) < at_time))


def competition_rank(rows: DataFrame, level: str, time: str, by: list[str] = (), out: str = "rank") -> DataFrame:
    """1 + the number of rows of the group that are strictly better; equal rows share a rank.

    The distinct (level, time) pairs are counted, their running total is made over range partitions, and the ranks
    are joined back, so neither the table nor a large group is sorted in one task. Null levels and times rank as the
    sort puts them: null levels and null times first.
    """
    by = list(by)
    steps = rows.groupBy(*by, F.col(level).alias("_level"), F.col(time).alias("_time")).agg(F.count(F.lit(1)).alias("_n"))
    steps = steps.withColumn("_down", -F.col("_level"))
    upto = running_total(steps, by, ["_down", "_time"], "_n", "_upto")
    ranks = upto.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_level", "_time", (F.col("_upto") - F.col("_n") + 1).alias(out))
    cond = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)] + [F.col(level).eqNullSafe(F.col("_level")), F.col(time).eqNullSafe(F.col("_time"))]
    return rows.join(ranks, cond).drop("_level", "_time", *[f"_b{i}" for i in range(len(by))])


def position(rows: DataFrame, order: list[tuple[str, bool]], out: str = "position") -> DataFrame:
    """1-based place in the whole order (column, descending), which should end in a unique key; equal rows differ.

    The places come from the sizes of range partitions, not from a sort in one task. Descending columns must be
    numbers.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    marked = rows.withColumns({k: (-F.col(c) if down else F.col(c)) for k, (c, down) in zip(keys, order, strict=True)}).withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(marked, [], keys, "_one", out).drop("_one", *keys)


def page(ranked: DataFrame, start: int, size: int = 21, on: str = "position") -> DataFrame:
    return ranked.where(F.col(on).between(start, start + size - 1))


def hide_names(rows: DataFrame, name: str, hidden: list[str]) -> DataFrame:
    """Leaves out names of the list whatever their case; an empty list leaves out nothing."""
    return rows.where(~F.lower(F.col(name)).isin([x.lower() for x in hidden])) if hidden else rows


def top_share(rows: DataFrame, value: str, share: float) -> DataFrame:
    """The rows at or above the value of the last row of the top ``share``; rows that tie with it are kept."""
    counted = rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_down", -F.col("_v"))
    upto = running_total(counted, [], ["_down"], "_n", "_upto")
    whole = rows.agg(F.count(F.lit(1)).alias("_whole"))
    needed = F.ceil(F.col("_whole") * share)
    cut = upto.join(F.broadcast(whole)).where(F.col("_upto") >= needed).agg(F.max("_v").alias("_cut"))  # one row
    return rows.join(F.broadcast(cut)).where(F.col(value) >= F.col("_cut")).drop("_cut")


def refine(found: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """The rows found so far that are in ``other`` too; repeated rows on the left survive."""
    return found.join(other.select(*key).distinct(), key, "left_semi")


def skip_known(refs: DataFrame, known: DataFrame, keys: list[tuple[Column, str]]) -> DataFrame:
    """The refs of which none of the keys is known; keys: (expression over refs, column of known)."""
    out = refs
    for i, (expression, column) in enumerate(keys):
        have = known.select(F.col(column).alias(f"_k{i}")).where(F.col(f"_k{i}").isNotNull()).distinct()
        out = out.withColumn(f"_r{i}", expression).join(have, F.col(f"_r{i}") == F.col(f"_k{i}"), "left_anti").drop(f"_r{i}")
    return out


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], values: list[str], changed_on: list[str]) -> DataFrame:
    """stored with incoming rows put in; a row that is there is replaced only if one of ``changed_on`` differs.

    action: kept, updated or inserted. One full outer join on the key, which is unique on both sides.
    """
    new = incoming.select(*[F.col(k).alias(f"_n_{k}") for k in key], *[F.col(v).alias(f"_n_{v}") for v in values])
    old = stored.select(*key, *values)
    joined = old.join(new, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_n_{k}") for k in key]), "full_outer")
    here, there = F.col(key[0]).isNotNull(), F.col(f"_n_{key[0]}").isNotNull()
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in changed_on])
    action = F.when(~here, "inserted").when(there & differs, "updated").otherwise("kept")
    take_new = F.col("_action") != "kept"
    cols = [F.coalesce(F.col(k), F.col(f"_n_{k}")).alias(k) for k in key] + [F.when(take_new, F.col(f"_n_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return joined.withColumn("_action", action).select(*cols, F.col("_action").alias("action"))


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """stored and the incoming rows whose key is not there yet, one for each key."""
    fresh = incoming.join(stored.select(*key), key, "left_anti").dropDuplicates(key)
    return stored.unionByName(fresh)


def delete_where_in(rows: DataFrame, doomed: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(doomed.select(*key).distinct(), key, "left_anti")


def limited(events: DataFrame, who: str, at: str, seconds: int, most: int, order: str) -> DataFrame:
    """Events that come when the same user had ``most`` or more in the seconds before: one range window per user.

    A user's events are sorted on disk where they do not fit; only the rows of the last ``seconds`` are held.
    """
    window = Window.partitionBy(who).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    return events.withColumn("recent", F.count(F.lit(1)).over(window)).where(F.col("recent") >= most)


def accept_up_to(stored: DataFrame, incoming: DataFrame, owner: str, order: str, most: int = 100) -> DataFrame:
    """incoming with ``accepted``: a list that has ``most`` entries or more takes no further one; rows come in ``order``.

    The stored lists are counted with partial counts; the incoming rows of a list are numbered by range partitions, so
    no list is brought together.
    """
    have = stored.groupBy(F.col(owner).alias("_owner")).agg(F.count(F.lit(1)).alias("_have"))
    numbered = running_total(incoming.withColumn("_one", F.lit(1).cast("bigint")), [owner], [order], "_one", "_nth").drop("_one")
    joined = numbered.join(have, F.col(owner).eqNullSafe(F.col("_owner")), "left")
    return joined.withColumn("accepted", F.coalesce("_have", F.lit(0)) + F.col("_nth") <= most).drop("_owner", "_have", "_nth")


def union_new_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Both tables by key, where the new row stands for the old one of its key; rows without a null key only.

    Keys that repeat within a table keep all of its rows.
    """
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def merge_by_id(tables: list[DataFrame], key: str, lists: list[str], firsts: list[str]) -> DataFrame:
    """One row per key over all tables: ``lists`` united without repeats, sorted; ``firsts`` from the first table that has
    a value. The sets of a key are as large as their distinct entries, not as the rows."""
    marked = reduce(DataFrame.unionByName, [t.select(key, *lists, *firsts).withColumn("_table", F.lit(i)) for i, t in enumerate(tables)])
    of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_table"))).alias(c)
    entry = lambda c: F.explode_outer(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias("_e")
    out = marked.groupBy(key).agg(*[of(c) for c in firsts]) if firsts else marked.select(key).distinct()
    for c in lists:
        united = marked.select(F.col(key).alias("_key"), entry(c)).groupBy("_key").agg(F.sort_array(F.collect_set("_e")).alias(c))
        out = out.join(united, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return out
