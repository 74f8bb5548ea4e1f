"""Exact range and k-nearest-neighbour queries over objects on a road network.

A position is an edge ``(u < v)`` of weight ``w`` and an offset from ``u``. With d(x) the shortest distance
from the query's position to vertex x,

    dist(q, o) = least(d(o.u) + o.offset_, d(o.v) + o.w - o.offset_)

A range query returns all objects with dist <= radius; a kNN query the first k by (dist, obj_id), without
unreachable ones. ``same_edge="direct"`` also allows the way along a shared edge; the default,
``"endpoint"``, always goes by an end of the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graph
from ..plans.fixpoint import Growing, Roads, distances
from ..plans.work import Workspace


def seeds(queries: DataFrame, radius: Column | None = None) -> DataFrame:
    """Both ends of each query's edge with their distances from the position."""
    ends = F.array(
        F.struct(F.col("u").alias("vid"), F.col("offset_").alias("dist")),
        F.struct(F.col("v").alias("vid"), (F.col("w") - F.col("offset_")).alias("dist")),
    )
    bound = radius if radius is not None else F.col("radius") if "radius" in queries.columns else F.lit(None).cast("bigint")
    return queries.select("query_id", bound.alias("radius"), F.explode(ends).alias("e")).select("query_id", "e.vid", "e.dist", "radius")


def vertex_seeds(queries: DataFrame) -> DataFrame:
    """A query at a vertex: ``queries(query_id, vid [, radius])``."""
    bound = F.col("radius") if "radius" in queries.columns else F.lit(None).cast("bigint")
    return queries.select("query_id", F.col("vid").cast("bigint").alias("vid"), F.lit(0).cast("bigint").alias("dist"), bound.alias("radius"))


def check_edges(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """Positions whose edge is not in the graph, has another weight, or whose offset is outside it; empty if all are sound."""
    found = positions.alias("p").join(edges.alias("e"), ["u", "v"], "left").select("p.*", F.col("e.w").alias("edge_w"))
    return found.where(F.col("edge_w").isNull() | (F.col("edge_w") != F.col("w")) | (F.col("offset_") < 0) | (F.col("offset_") > F.col("w")))


def object_distances(field: DataFrame, objects: DataFrame, queries: DataFrame | None = None, same_edge: str = "endpoint") -> DataFrame:
    """(query_id, obj_id, dist) by the ends that the field reaches: one join, on the vertex."""
    ends = F.array(
        F.struct(F.col("u").alias("vid"), F.col("offset_").cast("bigint").alias("more")),
        F.struct(F.col("v").alias("vid"), (F.col("w") - F.col("offset_")).cast("bigint").alias("more")),
    )
    ways = objects.select("obj_id", F.explode(ends).alias("e")).select("obj_id", "e.vid", "e.more")
    found = field.join(ways, "vid").select("query_id", "obj_id", (F.col("dist") + F.col("more")).alias("dist"))
    if same_edge == "direct":
        if queries is None:
            raise ValueError("the direct way needs the queries")
        q = queries.select("query_id", "u", "v", F.col("offset_").alias("at"))
        found = found.unionByName(objects.join(q, ["u", "v"]).select("query_id", "obj_id", F.abs(F.col("offset_") - F.col("at")).cast("bigint").alias("dist")))
    elif same_edge != "endpoint":
        raise ValueError(f"no such mode: {same_edge}")
    return found.groupBy("query_id", "obj_id").agg(F.min("dist").alias("dist"))


def exact_range(queries: DataFrame, objects: DataFrame, edges: DataFrame, same_edge: str = "endpoint", method: str = "auto") -> DataFrame:
    """(query_id, obj_id, dist) of all objects within each query's radius, inclusive."""
    field = distances(seeds(queries), graph.arcs(edges), method)
    found = object_distances(field, objects, queries, same_edge)
    return found.join(queries.select("query_id", "radius"), "query_id").where("dist <= radius").select("query_id", "obj_id", "dist")


def first_k(found: DataFrame, k: Column) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("dist", "obj_id")
    ranked = found.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
    return ranked.select("query_id", F.col("rnk").cast("bigint").alias("rnk"), "obj_id", "dist")


def exact_knn(queries: DataFrame, objects: DataFrame, edges: DataFrame, start: int | None = None, same_edge: str = "endpoint", method: str = "auto", at_vertex: bool = False) -> DataFrame:
    """(query_id, rnk, obj_id, dist): the first k of each ``queries(query_id, position, k)``.

    The radius grows by doubling, and each search goes on from where it stopped. A distance within the radius is final, so a query is done
    once it has k objects within it, or when no way leads out of what it has reached. Queries that are done leave the loop.
    """
    space = Workspace(queries.sparkSession, "knn")
    bounds = edges.agg(F.max("w").alias("longest"), F.avg("w").alias("mean")).first()
    if bounds.longest is None:
        return first_k(object_distances(distances(seeds(queries), graph.arcs(edges), method), objects), F.lit(0))
    widest = queries.agg(F.max("k")).first()[0] or 0
    radius = start or max(bounds.longest, int(2 * bounds.mean * max(1, widest) ** 0.5))
    left, out, near = queries.where("k > 0"), None, None
    grown = Growing(vertex_seeds(left) if at_vertex else seeds(left), Roads(graph.arcs(edges), method), space)
    while True:
        field = grown.grow(left.select("query_id", F.lit(radius).alias("radius")))
        found = object_distances(field, objects, None if at_vertex else left, same_edge)
        if near is not None:
            found = found.unionByName(near.join(left, "query_id", "left_semi")).groupBy("query_id", "obj_id").agg(F.min("dist").alias("dist"))
        near = space.table(found, "near")
        inside = near.where(F.col("dist") <= radius).groupBy("query_id").agg(F.count("*").alias("inside"))
        state = left.select("query_id", "k").join(inside, "query_id", "left").join(grown.open().withColumn("whole", F.lit(False)), "query_id", "left")
        state = state.select("query_id", "k", (F.coalesce("inside", F.lit(0)) >= F.col("k")).alias("enough"), F.coalesce("whole", F.lit(True)).alias("whole"))
        state = space.table(state, "state")
        done = state.where("enough or whole").join(near, "query_id").where(F.col("whole") | (F.col("dist") <= radius))
        done = space.table(first_k(done.select("query_id", "obj_id", "dist", "k"), F.col("k")), "done")
        out = done if out is None else out.unionByName(done)
        left = space.table(left.join(state.where("not enough and not whole").select("query_id"), "query_id", "left_semi"), "left")
        if left.isEmpty():
            return out
        radius *= 2


def objects_on(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects on the edges given in ``edges(u, v)``."""
    return objects.join(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), ["u", "v"], "left_semi")


def objects_in(objects: DataFrame, sg_edges: DataFrame) -> DataFrame:
    """Objects with the subgraph that owns their edge; an object on no owned edge is left out (see ``unowned``)."""
    return objects.join(sg_edges.select("u", "v", "sg_id"), ["u", "v"])


def unowned(objects: DataFrame, sg_edges: DataFrame) -> DataFrame:
    return objects.join(sg_edges, ["u", "v"], "left_anti")


def objects_at(objects: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, obj_id) of objects on edges that end at given vertices."""
    ends = objects.select("obj_id", F.explode(F.array("u", "v")).alias("vid"))
    return ends.join(vertices.select("vid"), "vid", "left_semi").select("vid", "obj_id")


def occupancy(objects: DataFrame, sg_edges: DataFrame) -> DataFrame:
    per = objects_in(objects, sg_edges).groupBy("sg_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("occupied"), F.sum("n").alias("objects"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def frontier(queries: DataFrame, edges: DataFrame, radii: list[int], borders: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """Per query and radius: vertices reached, border vertices among the frontier, arcs that lead outside.

    One field at the largest radius serves all of them.
    """
    arcs = graph.arcs(edges)
    field = distances(seeds(queries, F.lit(max(radii)).cast("bigint")), arcs, method)
    steps = field.withColumn("radius", F.explode(F.array(*[F.lit(r).cast("bigint") for r in radii]))).where("dist <= radius")
    out = steps.join(arcs, F.col("vid") == F.col("s")).where(F.col("dist") + F.col("w") > F.col("radius"))
    edge = out.groupBy("query_id", "radius").agg(F.count("*").alias("outward_arcs"), F.countDistinct("vid").alias("frontier_vertices"))
    reached = steps.groupBy("query_id", "radius").agg(F.count("*").alias("reached"))
    joined = reached.join(edge, ["query_id", "radius"], "left")
    if borders is not None:
        on = out.join(borders.select("vid").distinct(), "vid", "left_semi").groupBy("query_id", "radius").agg(F.countDistinct("vid").alias("frontier_borders"))
        joined = joined.join(on, ["query_id", "radius"], "left")
    return joined.na.fill(0)


def move_queries(queries: DataFrame, moves: DataFrame) -> DataFrame:
    """Queries with new offsets along their edges, from ``moves(query_id, offset_)``; others stay."""
    new = moves.select("query_id", F.col("offset_").alias("new_offset"))
    return queries.join(new, "query_id", "left").withColumn("offset_", F.coalesce("new_offset", "offset_")).drop("new_offset")


def continuous_range(queries: DataFrame, moves: DataFrame, objects: DataFrame, edges: DataFrame, before: DataFrame | None = None, method: str = "auto") -> DataFrame:
    """Results after some queries moved. Only those are searched again; the others keep the rows of ``before``."""
    moved = move_queries(queries, moves).join(moves.select("query_id"), "query_id", "left_semi")
    fresh = exact_range(moved, objects, edges, method=method)
    if before is None:
        before = exact_range(queries.join(moves.select("query_id"), "query_id", "left_anti"), objects, edges, method=method)
    return before.join(moves.select("query_id"), "query_id", "left_anti").unionByName(fresh)
