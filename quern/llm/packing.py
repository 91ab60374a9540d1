"""Filling containers of fixed capacity: first-fit decreasing with a tournament tree, in randomised groups.

The pieces are dealt into groups at random; each group is packed by itself, so a group is the largest thing that one
task holds, and its size is a parameter. The loss against packing all together is at most one partly filled
container per group and capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: items by falling size (ties in their order), each into the first that has room.

    The tournament tree holds the room left in each container; every inner node holds the larger of its two
    children, so the first container with enough room is found from the root in as many steps as the tree is high.
    A container that is not open yet has the whole capacity. Items larger than the capacity are an error.
    """
    n = len(sizes)
    if not n:
        return []
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [capacity] * (2 * leaves)
    placed = [0] * n
    for i in sorted(range(n), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        if size > capacity:
            raise ValueError(f"an item of {size} is larger than the capacity of {capacity}")
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        placed[i] = at - leaves
        room[at] -= size
        while at > 1:
            at //= 2
            left, right = room[2 * at], room[2 * at + 1]
            best = left if left >= right else right
            if room[at] == best:
                break
            room[at] = best
    return placed


def pieces(sized: DataFrame, capacities: DataFrame, most_packs: int = 1000) -> DataFrame:
    """One row per piece and capacity: an item above the capacity is split into whole containers and a rest.

    sized: id, n_tokens, slot, row. capacities: pack_name, capacity_tokens, a small table of the user's of at most
    ``most_packs`` rows. Items of no tokens stay items, as they take no room. A capacity that is null or below 1 is
    left out, and no capacity at all gives no pieces.
    """
    valid = capacities.where(F.col("capacity_tokens") >= 1).select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    rows = valid.limit(most_packs + 1).collect()
    if len(rows) > most_packs:
        raise ValueError(f"more than {most_packs} capacities")
    kind = "array<struct<pack_name:string,capacity:bigint>>"
    packs = F.array(*[F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity"]).alias("capacity")) for r in rows]).cast(kind)
    both = sized.withColumn("_pack", F.explode(packs)).select("id", "slot", "row", "n_tokens", "_pack.*")
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity"))).cast("int")
    cut_up = both.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("piece") * F.col("capacity")
    return cut_up.withColumn("start_token", start).withColumn("tokens", F.least(F.col("capacity"), F.col("n_tokens") - start))


def pack(sized: DataFrame, capacities: DataFrame, group_items: int = 20_000, total: int | None = None) -> DataFrame:
    """pack_name, container, id, piece, start_token, tokens, capacity: what is in each container.

    sized: id, n_tokens, slot (a hash of the row, by which it is dealt, whatever the files or the cluster) and row (a
    number that is unique and fixed with the table). A container's name is its group's number and its own. A null size counts
    as 0. Null and repeated ids are packed as any other. An empty table fills no container.
    """
    total = sized.count() if total is None else total
    groups = max(1, -(-total // group_items))
    items = sized.select("id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), "slot", "row")
    dealt = pieces(items, capacities).withColumn("bin_group", F.pmod(F.xxhash64("slot", "piece"), F.lit(groups)))
    # A piece that fills its container needs no search.
    full = dealt.where(F.col("tokens") == F.col("capacity")).select("pack_name", F.concat_ws("-", F.lit("full"), "row", "piece").alias("container"), "id", "piece", "start_token", "tokens", "capacity")
    open_ = dealt.where(F.col("tokens") < F.col("capacity")).select("pack_name", "bin_group", "capacity", "id", "slot", "row", "piece", "start_token", "tokens")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slot", "row", "piece"], kind="stable")
        places = first_fit_decreasing(group["tokens"].tolist(), int(group["capacity"].iloc[0]))
        return group.assign(container=[f"{g}-{p}" for g, p in zip(group["bin_group"], places, strict=True)])[["pack_name", "container", "id", "piece", "start_token", "tokens", "capacity"]]

    id_type = dict(sized.dtypes)["id"]
    schema = f"pack_name string, container string, id {id_type}, piece int, start_token bigint, tokens bigint, capacity bigint"
    return full.unionByName(open_.groupBy("pack_name", "bin_group").applyInPandas(run, schema))


def fill(packed: DataFrame) -> DataFrame:
    """Containers, tokens, unused tokens and share, and the fewest containers that could hold the tokens, per pack."""
    containers = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"), F.count(F.lit(1)).alias("n"))
    per_pack = containers.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity") - F.col("tokens")).alias("unused"), F.max("tokens").alias("fullest"), F.max("capacity").alias("capacity"))
    return per_pack.withColumn("unused_share", F.col("unused") / (F.col("unused") + F.col("tokens"))).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
