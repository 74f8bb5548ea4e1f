"""Graph tables and the projections, filters and set operations on them.

``edges(u, v, w)`` holds each road once with ``1 <= u < v`` and ``w >= 1``; ``arcs(s, d, w)`` holds both directions.
Parallel edges and differing weights of the two directions are settled by the smallest weight.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(rows: DataFrame, u: str = "u", v: str = "v", w: str = "w") -> DataFrame:
    """Undirected edges from directed or repeated ones; loops and vertex 0 are invalid and rejected by ``validate``."""
    ends = rows.select(F.least(u, v).cast("bigint").alias("u"), F.greatest(u, v).cast("bigint").alias("v"), F.col(w).cast("bigint").alias("w"))
    return ends.groupBy("u", "v").agg(F.min("w").alias("w"))


def validate(edges: DataFrame) -> DataFrame:
    """Rows that break an invariant, with the reason; empty for a sound graph."""
    reason = F.when(F.col("u") >= F.col("v"), "endpoints are not u < v").when(F.col("u") < 1, "vertex below 1").when(F.col("w") < 1, "weight below 1")
    return edges.withColumn("reason", reason).where("reason is not null")


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions, without reading the edges twice."""
    both = F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("d")), F.struct(F.col("v").alias("s"), F.col("u").alias("d")))
    return edges.select("w", F.explode(both).alias("a")).select("a.s", "a.d", "w")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("vid")).distinct()


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(vid, neighbour, w) of the vertices in ``of(vid)``."""
    return arcs(edges).join(of.select("vid"), F.col("s") == F.col("vid")).select("vid", F.col("d").alias("neighbour"), "w")


def connect(edges: DataFrame, more: DataFrame, policy: str = "last") -> DataFrame:
    """Edges with others added; an edge that is there takes the new weight (``last``) or the smaller one (``min``)."""
    all_rows = edges.withColumn("turn", F.lit(0)).union(more.select(F.least("u", "v"), F.greatest("u", "v"), "w", F.lit(1)))
    kept = F.min("w") if policy == "min" else F.max_by("w", "turn")
    return all_rows.groupBy("u", "v").agg(kept.alias("w"))


def disconnect(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those in ``gone(u, v)``, given in either direction. Vertices left without edges are gone too."""
    pairs = gone.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return edges.join(pairs, ["u", "v"], "left_anti")


def replace(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the weights of ``new(u, v, w)`` where they are there; others of ``new`` are ignored."""
    pairs = new.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("new_w"))
    return edges.join(pairs, ["u", "v"], "left").select("u", "v", F.coalesce("new_w", "w").alias("w"))


def lookup(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, has_edge, weight) for pairs in either direction."""
    found = pairs.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b")).join(edges, ["u", "v"], "left")
    return found.select("a", "b", F.col("w").isNotNull().alias("has_edge"), F.col("w").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return arcs(edges).groupBy(F.col("s").alias("vid")).agg(F.count("*").alias("degree"), F.min("w").alias("min_w"), F.max("w").alias("max_w"))


def edge_order(seed: int) -> Column:
    """A seeded order of edges that any engine can compute: no state, no generator."""
    return F.pmod(F.col("u") * F.lit(2654435761 + seed) + F.col("v") * F.lit(40503 + 2 * seed), F.lit(1000003))


def _cut(edges: DataFrame, order: Column, fraction: float) -> tuple[int, int]:
    """The order value in which a share of the edges ends, and how many edges of that value are in the share.

    Counts of blocks of 1,000 values and then of the values of one block are read, so 2,001 rows at most come to the driver.
    """
    at = edges.select(order.alias("at"))
    block = F.expr("at div 1000").alias("block")

    def find(counts: list[tuple[int, int]], left: int) -> tuple[int, int]:
        for value, n in counts:
            if left <= n:
                return value, left
            left -= n
        return counts[-1]

    counts = sorted(map(tuple, at.groupBy(block).count().collect()))
    if not counts:
        return 0, 0
    share = Decimal(sum(n for _, n in counts)) * Decimal(str(fraction))  # halves are rounded up, as SQL does
    k, left = find(counts, int(share.to_integral_value(ROUND_HALF_UP)))
    return find(sorted(map(tuple, at.where(block == k).groupBy("at").count().collect())), left)


def reweight(edges: DataFrame, fraction: float, scale: float, increase: bool = True, seed: int = 1) -> DataFrame:
    """A seeded share of edges, longer (at least as long as before) or shorter (at least 1).

    The share is exact by rank at any size; only the edges of the one order value in which it ends are ranked in one task.
    """
    order = edge_order(seed)
    value, last = _cut(edges, order, fraction)
    tied = edges.where(order == value).withColumn("r", F.row_number().over(Window.orderBy("u", "v")))
    chosen = edges.where(order != value).withColumn("r", F.lit(None).cast("int")).unionByName(tied)
    pick = (order < value) | (F.col("r") <= last)
    scaled = F.round(F.col("w") * F.lit(scale)).cast("bigint")
    new = F.greatest(F.col("w"), scaled) if increase else F.greatest(F.lit(1), scaled)
    return chosen.select("u", "v", F.when(pick, new).otherwise(F.col("w")).alias("w"))


def query_vertex(offset: Column, u: Column, v: Column, w: Column) -> Column:
    """The vertex that a position lies on, or null."""
    return F.when(offset == 0, u).when(offset == w, v)


def interpolate(positions: DataFrame, coords: DataFrame) -> DataFrame:
    """Coordinates of positions along their edges; a weight below 1 counts as 1."""
    share = F.col("offset_") / F.greatest(F.col("w"), F.lit(1))
    at_u = coords.select(F.col("vid").alias("u"), F.col("x").alias("xu"), F.col("y").alias("yu"))
    at_v = coords.select(F.col("vid").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv"))
    both = positions.join(at_u, "u").join(at_v, "v")
    return both.select(*positions.columns, (F.col("xu") + (F.col("xv") - F.col("xu")) * share).alias("x"), (F.col("yu") + (F.col("yv") - F.col("yu")) * share).alias("y"))


def grid_cells(points: DataFrame, coords: DataFrame, side: int) -> DataFrame:
    """Row-major cell of each point in a grid of ``side * side`` over the bounding box of ``coords``, clamped to it."""
    box = coords.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()

    def place(c: str, low: float, high: float) -> Column:
        return F.least(F.lit(side - 1), F.greatest(F.lit(0), F.floor((F.col(c) - F.lit(low)) / F.lit(max(high - low, 1e-12)) * side)))

    if box.x0 is None:
        return points.withColumn("cell", F.lit(None).cast("bigint"))
    return points.withColumn("cell", (place("y", box.y0, box.y1) * side + place("x", box.x0, box.x1)).cast("bigint"))


def packed(u: Column, v: Column) -> Column:
    """An edge as one number, for graphs of fewer than 2^31 vertices."""
    return F.shiftleft(u, 32).bitwiseOR(v)
