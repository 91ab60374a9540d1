"""Property graphs as two tables: edges merged with evidence, nodes merged in order, degrees, PageRank, expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut

EDGE_KEY = ["source", "target", "relation", "field"]


def merge_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge per (source, target, relation, field): weight summed, evidence counted, first sight; no self loops.

    A null field is a field of its own. Null sources and targets are no edges.
    """
    real = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")))
    return real.groupBy(*EDGE_KEY).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("evidence"), F.min(order).alias("first_seen"))


def merge_nodes(nodes: DataFrame, order: str, attributes: list[str]) -> DataFrame:
    """One row per id: for each attribute the last value that is not null, in input order; ``page`` kinds stay pages."""
    last = [F.max_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes if a != "kind"]
    kind = F.when(F.max(F.col("kind") == "page"), "page").otherwise(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col(order))))
    return nodes.groupBy("id").agg(kind.alias("kind"), *last, F.count(F.lit(1)).alias("deliveries"))


def known_at_sight(edges: DataFrame, nodes: DataFrame, at: str, seen: str) -> DataFrame:
    """The edges whose target had been seen as a node when they came; nodes: id and the time of its first sight."""
    first = nodes.groupBy("id").agg(F.min(seen).alias("_seen"))
    return edges.join(first, F.col("target") == F.col("id")).where(F.col("_seen") <= F.col(at)).drop("id", "_seen")


def degrees(nodes: DataFrame, edges: DataFrame, link_relation: str = "wiki_link") -> DataFrame:
    """In and out degrees of every node, counted, weighted, and of page links alone; 0 where there are none.

    Each edge is turned into one row per end before a single aggregation, so the edges are shuffled once and a hot
    target leaves every task as one row. Ends that are no nodes are dropped.
    """
    link = (F.col("relation") == link_relation).cast("bigint")
    end = lambda node, incoming: F.struct(F.col(node).alias("id"), F.lit(incoming).alias("incoming"), F.lit(1 - incoming).alias("outgoing"), F.col("weight"), link.alias("link"))
    flat = edges.select(F.explode(F.array(end("target", 1), end("source", 0))).alias("e")).select("e.*")
    sums = flat.groupBy("id").agg(
        F.sum("incoming").alias("indegree"), F.sum("outgoing").alias("outdegree"),
        F.sum(F.col("weight") * F.col("incoming")).alias("weighted_indegree"), F.sum(F.col("weight") * F.col("outgoing")).alias("weighted_outdegree"),
        F.sum(F.col("link") * F.col("incoming")).alias("link_indegree"), F.sum(F.col("link") * F.col("outgoing")).alias("link_outdegree"),
    )
    return nodes.select("id").distinct().join(sums, "id", "left").na.fill(0)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 25, damping: float = 0.85) -> DataFrame:
    """id, rank: weighted PageRank. Uniform start; the mass of nodes without outgoing weight is spread evenly.

    nodes: id, unique. edges: source, target, weight, between nodes; others are dropped. n counts all nodes.

    The nodes are numbered once, so that all rounds join, sort and group by numbers and not by names.

    With M the shares of the edges, round i + 1 is ``d M r + c_i``, where only the number ``c_i`` depends on the mass
    without outgoing weight. So ``r`` after all rounds is a weighted sum of ``v_j = (d M)^j 1``, and a round is one join
    of the shares, which are partitioned and sorted by source once, with the last ``v``, and one aggregation by target
    with partial sums before the shuffle (a hot target moves one row per task). Each ``v``, at most a row per node, is written, so
    plans do not grow with the rounds. The numbers ``c_i`` follow from the mass of each ``v`` that lies on nodes without outgoing weight, and the result is one
    aggregation over all ``v``. A source with very many edges is split by AQE's skew join.
    """
    spark = nodes.sparkSession
    ids = cut(nodes.select("id").distinct().withColumn("number", F.monotonically_increasing_id()), "pr-nodes")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    of = lambda end: ids.select(F.col("id").alias(end), F.col("number").alias(f"_{end}"))
    numbered = edges.select("source", "target", "weight").join(of("target"), "target").join(of("source"), "source")
    inside = numbered.groupBy(F.col("_source").alias("source"), F.col("_target").alias("target")).agg(F.sum("weight").alias("w"))
    out = inside.groupBy(F.col("source").alias("_s")).agg(F.sum("w").alias("_all")).where(F.col("_all") > 0)
    shares = cut(inside.join(out, F.col("source") == F.col("_s")).select("source", "target", (F.col("w") / F.col("_all")).alias("share")), "pr-shares")
    by_source = shares.repartition("source").sortWithinPartitions("source").persist()
    try:
        v, written = None, []
        for j in range(1, rounds + 1):
            joined = by_source.join(v.withColumnRenamed("number", "source"), "source") if v is not None else by_source.withColumn("v", F.lit(1.0))
            v = cut(joined.groupBy(F.col("target").alias("number")).agg((F.sum(F.col("v") * F.col("share")) * damping).alias("v")), "pr-v")
            written.append(v.withColumn("j", F.lit(j)))
    finally:
        by_source.unpersist()
    every = reduce(DataFrame.unionByName, written)
    ends = cut(ids.join(shares.select(F.col("source").alias("number")).distinct(), "number", "left_anti").select("number"), "pr-ends")
    masses = {0: float(ends.count()), **{r["j"]: r["m"] for r in every.join(ends, "number", "left_semi").groupBy("j").agg(F.sum("v").alias("m")).collect()}}
    c: list[float] = []
    for i in range(rounds):
        loose = sum(c[i - 1 - j] * masses.get(j, 0.0) for j in range(i)) + masses.get(i, 0.0) / n
        c.append(((1 - damping) + damping * loose) / n)
    weights = spark.createDataFrame([(j, c[rounds - 1 - j] if j < rounds else 1.0 / n) for j in range(1, rounds + 1)], "j int, weight double")
    got = every.join(F.broadcast(weights), "j").groupBy("number").agg(F.sum(F.col("v") * F.col("weight")).alias("got"))
    return ids.join(got, "number", "left").select("id", (F.coalesce("got", F.lit(0.0)) + F.lit(c[rounds - 1])).alias("rank"))


def edge_score(priority: Column, weight: Column, rank: Column, *dates: Column) -> Column:
    """Priority times weight, raised by the rank of the target; a fifth of it for each sign of a date."""
    score = priority * weight * (1 + F.log1p(rank * 1e5))
    for dated in dates:
        score = score * F.when(dated, 0.2).otherwise(1.0)
    return score


def top_edges(edges: DataFrame, score: Column, most: int = 250, tie: list[str] = ("target", "relation")) -> DataFrame:
    """The best edges of each source. A window with a row limit keeps only that many rows per source and task before
    the shuffle, so a hot source is cut down where it is read."""
    window = Window.partitionBy("source").orderBy(F.col("score").desc(), *tie)
    return edges.withColumn("score", score).withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= most)


def expand(seeds: DataFrame, edges: DataFrame, most: int, node_rank: DataFrame) -> DataFrame:
    """Neighbours over the first edges of each seed, with their ranks. seeds: id. edges: source, target, score, rn."""
    step = edges.where(F.col("rn") <= most).join(seeds.select(F.col("id").alias("source")).distinct(), "source")
    return step.join(node_rank.select(F.col("id").alias("target"), "rank"), "target", "left").select("source", "target", "relation", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def reach(start: DataFrame, edges: DataFrame, most_steps: int) -> DataFrame:
    """id, steps: the nodes that can be reached and the fewest steps to them, breadth first.

    Each round joins the frontier with the edges and drops what was reached before. It ends when the frontier is
    empty, so the number of rounds is the depth of the graph and not its size.
    """
    seen = cut(start.select("id").distinct().withColumn("steps", F.lit(0)), "reach")
    frontier, found = seen, [seen]
    links = edges.select("source", "target").distinct()
    for step in range(1, most_steps + 1):
        after = links.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).where(F.col("id").isNotNull()).distinct()
        known = reduce(DataFrame.unionByName, found)
        frontier = cut(after.join(known, "id", "left_anti").withColumn("steps", F.lit(step)), "reach")
        if frontier.isEmpty():
            break
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)
