"""Event logs: deltas, checks, replay, metrics, mergeable knowledge, sliding buffers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import previous


def step_delta(events: DataFrame, key: str, order: list[str], value: str, hot_rows: int = 2_000_000) -> DataFrame:
    """Adds ``delta`` from the event before of the same key and ``from_start`` from its first one.

    The first values are found by partial minima; keys with very many events are looked at in ranges.
    """
    first = events.groupBy(F.col(key).alias("_key")).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    before = previous(events, [key], order, [value], hot_rows)
    joined = before.join(first, F.col(key).eqNullSafe(F.col("_key")), "left")
    made = joined.withColumn("delta", F.col(value) - F.col(f"prev_{value}")).withColumn("from_start", F.col(value) - F.col("_first"))
    return made.drop("_key", "_first", f"prev_{value}")


def changed_only(events: DataFrame, key: str, order: list[str], value: str, hot_rows: int = 2_000_000) -> DataFrame:
    """The events whose value differs from that of the event before; the first of a key counts as a change."""
    before = previous(events, [key], order, [value], hot_rows)
    return before.where(~F.col(value).eqNullSafe(F.col(f"prev_{value}"))).drop(f"prev_{value}")


def state_delta(before: DataFrame, after: DataFrame, key: list[str], amount: str) -> DataFrame:
    """Difference of two states over the union of their keys; a key that is missing on one side counts as 0 there."""
    a = before.select(*key, F.col(amount).alias("_before"))
    b = after.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(amount).alias("_after"))
    joined = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), "full_outer")
    change = F.coalesce("_after", F.lit(0)) - F.coalesce("_before", F.lit(0))
    return joined.select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in key], change.alias("change"))


def metrics(runs: DataFrame, by: list[str], success: Column, measures: list[str], sums: list[str] = ()) -> DataFrame:
    """Runs, successes, failures, rate, means and sums per group; a missing measure counts as 0 in its mean and sum."""
    means = [F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(f"avg_{m}") for m in measures]
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_if(success).alias("successes"), F.count_if(~F.coalesce(success, F.lit(False))).alias("failures"), *means, *[F.sum(F.coalesce(F.col(m), F.lit(0))).alias(f"sum_{m}") for m in sums]).withColumn("rate", F.col("successes") / F.col("runs"))


def verify(states: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Adds passed and failed, the names of the checks, and success: no check failed. A null outcome is a failure."""
    marks = [F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok")) for name, ok in checks.items()]
    every = F.array(*marks)
    names = lambda keep: F.transform(F.filter(every, keep), lambda x: x["name"])
    out = states.withColumn("passed", names(lambda x: x["ok"])).withColumn("failed", names(lambda x: ~x["ok"]))
    return out.withColumn("success", F.size("failed") == 0)


def compare_as(condition: Column, value: Column, against: Column) -> Column:
    """A comparison whose operator is data: >, <, = or !; false for any other."""
    return F.coalesce(F.when(condition == ">", value > against).when(condition == "<", value < against).when(condition == "=", value == against).when(condition == "!", value != against), F.lit(False))


def observe(sightings: DataFrame, key: list[str], tick: str, order: str, options: str) -> DataFrame:
    """Knowledge per key: times seen, the tick of the last observation (not the largest), the options ever seen.

    The option set of a key is the set of distinct options, not the list of sightings.
    """
    return sightings.groupBy(*key).agg(F.count(F.lit(1)).alias("seen"), F.max_by(tick, order).alias("last_tick"), F.sort_array(F.collect_set(options)).alias("options"))


def merge_knowledge(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Two knowledge tables in one: times added, the larger tick, the union of the options."""
    both = a.unionByName(b)
    return both.groupBy(*key).agg(F.sum("seen").alias("seen"), F.max("last_tick").alias("last_tick"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("options")))).alias("options"))


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key, found by partial maxima and not by a sort."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in columns])


def sliding_buffer(events: DataFrame, key: str, at: str, order: str, seconds: int, most: int) -> DataFrame:
    """What a buffer of the last ``most`` events, none older than ``seconds``, holds for each key at its last event."""
    window = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(order).desc())
    # The row limit comes first, so each task keeps ``most`` rows of a key; the newest is found among these.
    held = events.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= most)
    held = held.withColumn("_last", F.max(at).over(Window.partitionBy(key)))
    age = F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return held.where(age < seconds * 1_000_000).drop("_rn", "_last")


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Rows per bucket; a bucket holds what is at most its bound, the last one the rest; empty buckets count 0."""
    labels = [*map(str, bounds), "+Inf"]
    of = reduce(lambda acc, i: acc.when(F.col(value) <= bounds[i], i), range(len(bounds)), F.when(F.lit(False), -1)).otherwise(len(bounds))
    counted = rows.where(F.col(value).isNotNull()).groupBy(of.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame(list(enumerate(labels)), "bucket int, bound string")
    return every.join(counted, "bucket", "left").select("bound", F.coalesce("n", F.lit(0)).alias("n"))


def milestones(rows: DataFrame, key: str, order: list[str], total: str, step: int, exact: list[int] = (), hot_rows: int = 2_000_000) -> DataFrame:
    """The events at which a running total reaches a new multiple of ``step``, or exactly one of ``exact``."""
    was = F.coalesce(F.col(f"prev_{total}"), F.lit(0))
    crossed = F.floor(F.col(total) / step) > F.floor(was / step)
    met = F.col(total).isin(list(exact)) & (was != F.col(total))
    return previous(rows, [key], order, [total], hot_rows).where(crossed | met).drop(f"prev_{total}")


def replay(logged: DataFrame, key: str, order: list[str], value: str, check: Column) -> DataFrame:
    """Recompute the verdict of each key from its logged rows: first, last, and whether the check holds.

    check: over ``first`` and ``last``.
    """
    at = F.struct(*order)
    ends = logged.groupBy(key).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.count(F.lit(1)).alias("steps"))
    return ends.withColumn("verdict", F.coalesce(check, F.lit(False)))


def champions(gains: DataFrame, field: str, who: str, points: str, order: str, slots: int) -> DataFrame:
    """field, who, points: in each field the contributor with the most points; gains below 1 do not count.

    Only the first ``slots`` contributors of a field, by their first gain, have a place; ties go to the earlier one.
    Gains are summed per contributor with partial sums, and the window keeps ``slots`` rows per field and task.
    """
    summed = gains.where(F.col(points) >= 1).groupBy(field, who).agg(F.sum(points).alias("points"), F.min(order).alias("_first"))
    place = Window.partitionBy(field).orderBy("_first", who)
    placed = summed.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= slots)
    best = F.max_by(F.struct(who, "points"), F.struct("points", -F.col("_place")))
    return placed.groupBy(field).agg(best.alias("_b")).select(field, f"_b.{who}", "_b.points")


def observe_places(sightings: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """The distinct places of each key, sorted, as array of struct; as large as the places and not as the sightings."""
    return sightings.select(*key, *place).distinct().groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*place))).alias("places"))


def check_column(kind: str, spec: dict) -> Column:
    """One check of a state (inventory, gained: maps of counts; xp: map of gains; levels: map; x, z, level; open: map of
    screens; messages: array), by its kind. Missing entries count as 0 or closed; an unknown kind is an error."""
    held = lambda of, k: F.coalesce(F.try_element_at(F.col(of), F.lit(k)), F.lit(0))
    if kind in ("inventory_contains", "inventory_lacks"):
        return held("inventory", spec["item"]) >= spec.get("count", 1) if kind == "inventory_contains" else held("inventory", spec["item"]) == 0
    if kind == "inventory_gained":
        hits = F.map_values(F.map_filter("gained", lambda k, v: k.rlike(f"(?i){spec['item']}")))
        return F.aggregate(F.coalesce(hits, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x) >= spec.get("count", 1)
    if kind == "xp_gained":
        return held("xp", spec["skill"]) >= spec.get("min", 1)
    if kind == "level_at_least":
        return held("levels", spec["skill"]) >= spec["level"]
    if kind == "position_within":
        near = F.greatest(F.abs(F.col("x") - spec["x"]), F.abs(F.col("z") - spec["z"])) <= spec["tolerance"]
        return near & (F.col("level") == spec["level"]) if "level" in spec else near
    if kind == "ui_open":
        return F.coalesce(F.try_element_at(F.col("open"), F.lit(spec["ui"])), F.lit(False))
    if kind == "message_matches":
        return F.exists(F.coalesce("messages", F.array().cast("array<string>")), lambda m: m.rlike(f"(?i){spec['pattern']}"))
    raise ValueError(f"no check of kind {kind}")
