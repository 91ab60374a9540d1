"""Inventories as rows (owner, slot, item, amount): totals with the stack limit, sums over item attributes, space."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STACK_LIMIT = 2**31 - 1


def totals(inventory: DataFrame, by: list[str]) -> DataFrame:
    return inventory.groupBy(*by).agg(F.least(F.sum("amount"), F.lit(STACK_LIMIT)).alias("total"))


def attribute_totals(inventory: DataFrame, items: DataFrame, attribute: str, by: list[str]) -> DataFrame:
    """Per owner: the attribute summed once per occupied slot, and times the amount of the slot."""
    joined = inventory.join(items.select("item", attribute), "item")
    return joined.groupBy(*by).agg(F.sum(attribute).alias("per_slot"), F.sum(F.col(attribute) * F.col("amount")).alias("per_unit"))


def free_space(inventory: DataFrame, by: list[str], capacity: int) -> DataFrame:
    return inventory.groupBy(*by).agg(F.lit(capacity).cast("bigint").__sub__(F.count_distinct("slot")).alias("free"))


def overflow(total: Column, free: Column, amount: Column, stacks: Column) -> Column:
    """How much of ``amount`` finds no room: stackable items share a slot up to the limit, others take one each."""
    room = F.when(stacks, F.when((total > 0) | (free > 0), F.lit(STACK_LIMIT) - total).otherwise(0)).otherwise(free)
    return F.when(amount == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), amount - room))


def apply_log(log: DataFrame, owner: str, order: str, capacity: int) -> DataFrame:
    """The slots of each owner after its log of additions and removals, row by row: owner, slot, item, amount.

    log: item, amount (negative to remove), all_or_nothing. An addition goes to the item's own slot, else to the
    first free one; what has no room is left out, or all of it if all_or_nothing. An owner's log is read as a
    stream in its order; memory holds one owner's slots, which ``capacity`` bounds.
    """
    owner_type = dict(log.dtypes)[owner]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, slots = None, {}

        def rows() -> pd.DataFrame:
            held = [(current, s, i, n) for s, (i, n) in sorted(slots.items())]
            return pd.DataFrame(held, columns=[owner, "slot", "item", "amount"])

        for batch in batches:
            for who, item, amount, strict in batch[[owner, "item", "amount", "all_or_nothing"]].itertuples(index=False):
                if who != current:
                    if slots:
                        yield rows()
                    current, slots = who, {}
                at = next((s for s, (i, _) in slots.items() if i == item), None)
                have = slots[at][1] if at is not None else 0
                if amount >= 0:
                    if at is None:
                        at = next((s for s in range(capacity) if s not in slots), None)
                    room = STACK_LIMIT - have if at is not None else 0
                    taken = 0 if strict and amount > room else min(amount, room)
                else:
                    taken = 0 if strict and -amount > have else -min(-amount, have)
                if at is not None and taken:
                    if have + taken:
                        slots[at] = (item, have + taken)
                    else:
                        slots.pop(at, None)
        if slots:
            yield rows()

    placed = log.where(F.col(owner).isNotNull()).repartition(F.col(owner)).sortWithinPartitions(owner, order)
    return placed.mapInPandas(run, f"{owner} {owner_type}, slot int, item bigint, amount bigint")


def slot_contents(queries: DataFrame, inventory: DataFrame, owner: str) -> DataFrame:
    """queries (owner, slot) with item (-1 if empty) and amount (0 if empty) of the slot."""
    have = inventory.select(F.col(owner).alias("_owner"), F.col("slot").alias("_slot"), F.col("item").alias("_item"), F.col("amount").alias("_amount"))
    joined = queries.join(have, (F.col(owner) == F.col("_owner")) & (F.col("slot") == F.col("_slot")), "left")
    return joined.withColumn("item", F.coalesce("_item", F.lit(-1))).withColumn("amount", F.coalesce("_amount", F.lit(0))).drop("_owner", "_slot", "_item", "_amount")


def stock_base(stock: Column, item: Column) -> Column:
    """The stock of an item in a shop, a map of items to counts: -1 where the shop has no stock list or not the item."""
    return F.coalesce(F.try_element_at(stock, item), F.lit(-1))
