"""Nested values: variant grouping, counts as maps, order-preserving sets, planning over sets of facts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut


def count_map(rows: DataFrame, by: list[str], name: str, amount: str) -> DataFrame:
    """``counts``: a map from name to summed amount, sorted by name; its size is that of the distinct names."""
    sums = rows.groupBy(*by, name).agg(F.sum(amount).alias("_n"))
    return sums.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "_n")))).alias("counts"))


def variants(rows: DataFrame, by: list[str], variant: list[str], instance: list[str], order: str, most: int) -> DataFrame:
    """Two-level grouping of the first ``most`` rows of each group: variants, each with its instances in order."""
    window = Window.partitionBy(*by).orderBy(order)
    first = rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= most)
    inner = first.groupBy(*by, *variant).agg(F.min("_rn").alias("_first"), F.array_sort(F.collect_list(F.struct("_rn", *instance))).alias("_i"))
    kept = F.transform("_i", lambda x: F.struct(*[x[c].alias(c) for c in instance]))
    outer = F.array_sort(F.collect_list(F.struct("_first", *variant, kept.alias("instances"))))
    return inner.groupBy(*by).agg(outer.alias("_v")).select(*by, F.transform("_v", lambda x: F.struct(*[x[c].alias(c) for c in variant], x["instances"].alias("instances"))).alias("variants"))


def heading_paths(headings: DataFrame, key: str, items: str) -> DataFrame:
    """key, at, path: for an array of struct<level, line> the path of lines from the top level to each heading.

    A fold over the array with the stack of open headings as its state.
    """
    seen = F.aggregate(
        F.col(items),
        F.struct(F.array().cast("array<struct<level:int,line:string>>").alias("stack"), F.array().cast("array<string>").alias("out")),
        lambda acc, h: _push(acc, h),
        lambda acc: acc["out"],
    )
    return headings.select(key, F.posexplode(seen).alias("at", "path"))


def _push(acc: Column, h: Column) -> Column:
    level = F.coalesce(h["level"].try_cast("int"), F.lit(1))
    stack = F.concat(F.filter(acc["stack"], lambda s: s["level"] < level), F.array(F.struct(level.alias("level"), F.coalesce(h["line"], F.lit("")).alias("line"))))
    path = F.array_join(F.transform(stack, lambda s: s["line"]), " > ")
    return F.struct(stack.cast("array<struct<level:int,line:string>>").alias("stack"), F.concat(acc["out"], F.array(path)).alias("out"))


def fact_name(value: Column) -> Column:
    """Trimmed, in lower case, anything but letters a-z and digits as one ``_``, none at the ends; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def alternatives(value: Column) -> Column:
    """The names between bars, as fact names; empty ones are dropped, repeats stay."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), fact_name), lambda x: x != "")


def _facts(prefix: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(f"{prefix}:"), n))


def _first(args: Column, *keys: str) -> Column:
    return F.coalesce(*[F.try_element_at(args, F.lit(k)) for k in keys])


def predicate_facts(kind: Column, args: Column) -> Column:
    """The facts that a predicate asks for, any of which will do: kind, and args, a map of texts. Other kinds ask for none."""
    one = lambda prefix, *keys: F.array(F.concat(F.lit(f"{prefix}:"), fact_name(_first(args, *keys))))
    many = lambda prefix, *keys: _facts(prefix, alternatives(_first(args, *keys)))
    places, options = alternatives(_first(args, "loc", "name")), alternatives(_first(args, "option", "optionText"))
    pairs = F.flatten(F.transform(places, lambda p: F.transform(options, lambda o: F.concat(F.lit("near_loc_option:"), p, F.lit(":"), o))))
    level = F.concat(F.lit("skill_at_least:"), fact_name(_first(args, "skill")), F.lit(":"), F.coalesce(_first(args, "level"), F.lit("1")))
    rules = {
        "has_item": one("has_item", "item"), "near_loc": many("near_loc", "name", "loc"), "near_loc_option": pairs, "near_npc": many("near_npc", "name", "npc"),
        "skill_at_least": F.array(level), "reachable": many("reachable", "target", "name", "loc"),
    }
    return _by_kind(kind, rules)


def effect_facts(kind: Column, args: Column) -> Column:
    """The facts that an effect brings about: kind, and args, a map of texts. Other kinds bring none."""
    one = lambda prefix, *keys: F.concat(F.lit(f"{prefix}:"), fact_name(_first(args, *keys)))
    many = lambda prefix, *keys: _facts(prefix, alternatives(_first(args, *keys)))
    bare = ("interface_opened", "interface_closed", "dialog_opened", "dialog_closed", "bank_changed", "shop_changed", "combat_started")
    rules = {
        "item_added": F.array(one("has_item", "item"), one("item_gained", "item")), "xp_gained": F.array(one("xp_gained", "skill")), "near_loc": many("near_loc", "name", "loc"),
        "reachable": many("reachable", "target", "name", "loc"), "message_observed": F.array(one("message_observed", "pattern", "message")), "level_changed": F.array(one("level_changed", "skill")),
        **{k: F.array(one(k, "target", "name", "varp")) for k in ("position_changed", "varp_changed")}, **{k: F.array(F.lit(k)) for k in bare},
    }
    return _by_kind(kind, rules)


def _by_kind(kind: Column, rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(kind == k, facts) for k, facts in rules.items()], F.array().cast("array<string>"))


#: The parts of a screen that can be open.
SCREENS = ("bank", "shop", "dialog", "interface", "modal")


def state_facts(inventory: Column, locs: Column, npcs: Column, ground: Column, ui: Column, skills: Column) -> Column:
    """The facts that hold in a state, sorted and distinct.

    inventory: map of item to count. locs: array of struct<name, options array>. npcs: array of names. ground: array of
    struct<name, count>. ui: map of SCREENS to whether it is open. skills: array of struct<name, level, xp>. Null parts
    hold nothing, as do items of a count of 0 or less; null options count as none.
    """
    some = lambda c: F.filter(c, lambda x: x["count"] > 0)
    held = F.transform(F.filter(F.map_entries(inventory), lambda e: e["value"] > 0), lambda e: fact_name(e["key"]))
    near = F.transform(locs, lambda g: fact_name(g["name"]))
    offers = F.flatten(F.transform(locs, lambda g: F.transform(F.coalesce(g["options"], F.array().cast("array<string>")), lambda o: F.concat(fact_name(g["name"]), F.lit(":"), fact_name(o)))))
    shown = F.filter(F.array(*[F.when(F.try_element_at(ui, F.lit(x)), F.lit(f"{x}_open")) for x in SCREENS]), lambda x: x.isNotNull())
    levels = F.transform(skills, lambda k: F.concat(fact_name(k["name"]), F.lit(":"), k["level"].cast("string")))
    learned = F.transform(F.filter(skills, lambda k: k["xp"] > 0), lambda k: fact_name(k["name"]))
    parts = {
        "has_item": held, "near_loc": near, "near_loc_option": offers, "near_npc": F.transform(npcs, fact_name), "ground_item": F.transform(some(ground), lambda g: fact_name(g["name"])),
        "ui": shown, "skill_at_least": levels, "has_xp": learned,
    }
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(_facts(k, v), none) for k, v in parts.items()]))))


def apply_action(facts: Column, add: Column, remove: Column) -> Column:
    """The facts after an action: what it adds wins over what it removes."""
    return F.array_sort(F.array_distinct(F.concat(F.array_except(facts, remove), add)))


def may_act(facts: Column, groups: Column) -> Column:
    """Every group of alternatives has one that holds."""
    return F.forall(groups, lambda g: F.arrays_overlap(facts, g))


def plan(start: list[str], goal: list[str], actions: DataFrame, most_steps: int) -> DataFrame:
    """steps, facts, actions: the shortest sequences of actions from the start facts to the goal, the first by name.

    actions: name, needs (array of arrays of alternatives), adds, removes; a small table of a domain, which every
    state is paired with in each round. States are sets of facts in sorted order; a state that was reached before is
    not visited again. Rounds end at the goal, at ``most_steps`` or when nothing new is reached.
    """
    spark = actions.sparkSession
    frontier = spark.createDataFrame([(0, sorted(set(start)), [])], "steps int, facts array<string>, actions array<string>")
    seen = [cut(frontier, "plan")]
    frontier = seen[0]
    wanted = F.array(*map(F.lit, goal))
    done = lambda states: states.where(F.size(F.array_except(wanted, F.col("facts"))) == 0)
    for step in range(1, most_steps + 1):
        if not done(frontier).isEmpty():
            break
        tried = frontier.join(actions, may_act(F.col("facts"), F.col("needs")))
        after = tried.select(F.lit(step).alias("steps"), apply_action(F.col("facts"), F.col("adds"), F.col("removes")).alias("facts"), F.concat("actions", F.array("name")).alias("actions"))
        fresh = after.groupBy("facts").agg(F.min("actions").alias("actions")).select(F.lit(step).alias("steps"), "facts", "actions")
        known = reduce(DataFrame.unionByName, seen).select("facts")
        frontier = cut(fresh.join(known, "facts", "left_anti").select("steps", "facts", "actions"), "plan")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return done(frontier).orderBy("actions").limit(1)


def masked(rows: DataFrame, text: str, words: list[str], allowed: list[str] = ()) -> DataFrame:
    """The text with every listed word written as ``*``; allowed phrases stay, and so does the case of the rest."""
    import re

    bad = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")\b", re.I) if words else None
    keep = [a.lower() for a in allowed]

    def one(x: str | None) -> str | None:
        if x is None or bad is None:
            return x
        low = x.lower()
        safe = [(m.start(), m.end()) for a in keep for m in re.finditer(re.escape(a), low)]
        return bad.sub(lambda m: m.group() if any(s <= m.start() and m.end() <= e for s, e in safe) else "*" * len(m.group()), x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{text: [one(x) for x in batch[text]]})

    return rows.mapInPandas(run, rows.schema)
