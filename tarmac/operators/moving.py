"""Queries that move along their edge: fields are shifted, and only what may change is searched again.

A field has the side by which each vertex is reached from the query, ``l`` by the end ``u`` of its edge or ``r`` by ``v``. When the query moves by
delta towards one end, vertices reached by that side are nearer by delta, for good. Those of the other side are farther by delta, unless a way by the
near side is shorter now; and vertices that were beyond the radius may come into it by the near side. So a search starts on the arcs that leave the
near side, never enters it, and goes on only where it is below the shifted distance of the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import Roads, origins, search_on
from ..plans.work import Workspace
from .queries import move_queries, object_distances, seeds

KEY = ["query_id", "vid"]


def sided_field(queries: DataFrame, arcs: DataFrame | Roads, method: str = "auto") -> DataFrame:
    """(query_id, vid, dist, side) within each query's radius; of two equal ways the one by ``u``."""
    found = origins(seeds(queries), arcs, method).join(queries.select("query_id", "u"), "query_id")
    return found.select(*KEY, "dist", F.when(F.col("origin") == F.col("u"), "l").otherwise("r").alias("side"))


def moved_field(field: DataFrame, queries: DataFrame, moves: DataFrame, roads: Roads, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """The field after ``moves(query_id, offset_)``, and (query_id, vid, dist) of the vertices that were searched for it.

    Fields of queries that do not move stay as they are, as do those that move by nothing. Equal ways keep the side they had.
    """
    new = moves.select("query_id", F.col("offset_").alias("new"))
    q = queries.join(new, "query_id").withColumn("delta", F.col("new") - F.col("offset_")).where("delta != 0")
    q = space.table(q.select("query_id", "u", "v", "w", "new", "radius", "delta", F.when(F.col("delta") > 0, "r").otherwise("l").alias("ahead")), "moves")
    rows = field.join(q, "query_id")
    near = space.table(rows.where("side = ahead").select(*KEY, (F.col("dist") - F.abs("delta")).alias("dist"), "side", "radius"), "near")
    far = rows.where("side != ahead").withColumn("dist", F.col("dist") + F.abs("delta")).where("dist <= radius")
    far = space.table(far.select(*KEY, "dist", "side"), "far")
    end = F.when(F.col("ahead") == "r", F.col("v")).otherwise(F.col("u"))
    to_end = F.when(F.col("ahead") == "r", F.col("w") - F.col("new")).otherwise(F.col("new"))
    direct = q.select("query_id", end.alias("vid"), to_end.cast("bigint").alias("dist"), "radius")
    out = near.join(roads.arcs, F.col("vid") == F.col("s")).select("query_id", F.col("d").alias("vid"), (F.col("dist") + F.col("w")).alias("dist"), "radius")
    start = out.unionByName(direct).where("dist <= radius").groupBy(*KEY).agg(F.min("dist").alias("dist"), F.max("radius").alias("radius"))
    searched = space.table(search_on(space, start, roads, near.select(*KEY), far.select(*KEY, "dist")), "searched")
    fresh = searched.join(q.select("query_id", F.col("ahead").alias("side")), "query_id")
    still = field.join(q.select("query_id"), "query_id", "left_anti").select(*KEY, "dist", "side")
    after = near.select(*KEY, "dist", "side").unionByName(fresh.select(*KEY, "dist", "side")).unionByName(far.join(searched, KEY, "left_anti")).unionByName(still)
    return space.table(after, "moved"), searched


class MovingQueries:
    """Standing range queries that move: their fields, where they are, and their results after each round of moves."""

    def __init__(self, queries: DataFrame, arcs: DataFrame, method: str = "auto") -> None:
        self.space, self.roads = Workspace(queries.sparkSession, "moving"), Roads(arcs, method)
        self.queries = self.space.table(queries, "queries")
        self.field = self.space.table(sided_field(queries, self.roads), "field")

    def move(self, moves: DataFrame) -> DataFrame:
        """Move, and give what was searched: (query_id, vid, dist)."""
        self.field, searched = moved_field(self.field, self.queries, moves, self.roads, self.space)
        self.queries = self.space.table(move_queries(self.queries, moves), "queries")
        return searched

    def results(self, objects: DataFrame) -> DataFrame:
        """(query_id, obj_id, dist)."""
        found = object_distances(self.field.select(*KEY, "dist"), objects)
        return found.join(self.queries.select("query_id", "radius"), "query_id").where("dist <= radius").select("query_id", "obj_id", "dist")
