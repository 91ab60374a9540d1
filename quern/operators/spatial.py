"""Range and nearest-neighbour joins on a grid: points are hashed to cells, and only cells in reach are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chebyshev(ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    return F.greatest(F.abs(ax - bx), F.abs(az - bz))


def within(queries: DataFrame, points: DataFrame, reach: int, query_id: str, point_id: str) -> DataFrame:
    """Pairs on the same level at a Chebyshev distance of at most ``reach``; both sides have level, x, z.

    A cell is as wide as the reach, so a query meets the points of nine cells: the queries are repeated nine times,
    the points not at all, and the join is an equi-join on (level, cell). distance and d2 (squared Euclidean) are
    added. A null coordinate is near nothing.
    """
    width = max(1, reach)
    cell = lambda c: F.floor(F.col(c) / width)
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx in (-1, 0, 1) for dz in (-1, 0, 1)])
    q = queries.select(F.col(query_id).alias("query"), "level", F.col("x").alias("qx"), F.col("z").alias("qz"), cell("x").alias("cx"), cell("z").alias("cz"), F.explode(near).alias("o"))
    q = q.select("query", "qx", "qz", "level", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cz") + F.col("o.dz")).alias("cz"))
    p = points.select(F.col(point_id).alias("point"), "level", F.col("x").alias("px"), F.col("z").alias("pz"), cell("x").alias("cx"), cell("z").alias("cz"))
    far = chebyshev(F.col("qx"), F.col("qz"), F.col("px"), F.col("pz"))
    d2 = (F.col("qx") - F.col("px")) * (F.col("qx") - F.col("px")) + (F.col("qz") - F.col("pz")) * (F.col("qz") - F.col("pz"))
    return q.join(p, ["level", "cx", "cz"]).withColumn("distance", far).where(F.col("distance") <= reach).withColumn("d2", d2).select("query", "point", "px", "pz", "distance", "d2")


def nearest(pairs: DataFrame) -> DataFrame:
    """The point with the least squared Euclidean distance to each query. The scan goes by x, then z, downward, and
    the last of equals stays; that is the smallest x, then z, then the largest point id."""
    best = F.min_by(F.struct("point", "d2"), F.struct("d2", "px", "pz", -F.col("point")))
    return pairs.groupBy("query").agg(best.alias("b")).select("query", "b.point", "b.d2")


def nearest_ranked(pairs: DataFrame, most: int) -> DataFrame:
    window = Window.partitionBy("query").orderBy("distance", "d2", "point")
    return pairs.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= most)


def box_counts(boxes: DataFrame, points: DataFrame, cell: int = 64) -> DataFrame:
    """Points inside each box (box, level, x0, z0, x1, z1, all inclusive): boxes are cut into cells and equi-joined."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    b = boxes.where((F.col("x0") <= F.col("x1")) & (F.col("z0") <= F.col("z1"))).withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cz", F.explode(span("z0", "z1")))
    p = points.select("level", "x", "z", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("z") / cell).alias("cz"))
    inside = b.join(p, ["level", "cx", "cz"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("z").between(F.col("z0"), F.col("z1")))
    counted = inside.groupBy("box").agg(F.count(F.lit(1)).alias("n"))
    return boxes.select("box").join(counted, "box", "left").select("box", F.coalesce("n", F.lit(0)).alias("n"))


def find_at(queries: DataFrame, things: DataFrame, kind: str, order: str) -> DataFrame:
    """queries with ``thing``: the first thing of the kind that stands at (level, x, z), null if there is none."""
    key = ["level", "x", "z", kind]
    first = things.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min(order).alias("thing"))
    return queries.join(first, [F.col(k) == F.col(f"_{k}") for k in key], "left").drop(*[f"_{k}" for k in key])


def in_zone(queries: DataFrame, things: DataFrame, query_id: str, thing_id: str, zone: int = 8) -> DataFrame:
    """query, thing: all things of the zone, ``zone`` squares wide, in which each query lies; an equi-join on the zone."""
    at = lambda df, of, name: df.select(F.col(of).alias(name), "level", F.floor(F.col("x") / zone).alias("zx"), F.floor(F.col("z") / zone).alias("zz"))
    return at(queries, query_id, "query").join(at(things, thing_id, "thing"), ["level", "zx", "zz"]).select("query", "thing")
