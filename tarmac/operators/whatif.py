"""What would change if a border were none: all such scenarios in one search, each with a key of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import rounds_of
from .reports import exposure
from .skeleton import Skeleton


def most_touched(skeleton: Skeleton, queries: DataFrame, limit: int) -> DataFrame:
    """(sg_id, border) of the borders that most queries reach, in each of their subgraphs; the first ``limit`` by touches, subgraph and border."""
    touches = exposure(skeleton.border_distances(queries), skeleton.border_sg).join(skeleton.border_sg, "border")
    return touches.orderBy(F.col("touches").desc(), "sg_id", "border").limit(limit).select("sg_id", "border")


def demotion_verdicts(skeleton: Skeleton, queries: DataFrame, objects: DataFrame, demoted: DataFrame) -> DataFrame:
    """(sg_id, border, results, lost, farther, exact): range results of a batch if a border of ``demoted(sg_id, border)`` were an inner vertex of its subgraph.

    A scenario takes away the ways into and out of that subgraph at that vertex. ``lost`` results are no longer within the radius, ``farther`` ones
    still are, at another distance, and ``exact`` is a demotion that changes neither (so neither ranges nor nearest objects within the radius).
    """
    space = skeleton.space
    demoted = space.table(demoted.select(F.col("sg_id").alias("sg"), F.col("border").alias("out")).distinct(), "demoted")
    clique = space.table(skeleton.clique(), "clique")
    asked = queries.select("query_id", "radius")
    entry = skeleton.entry(queries).join(skeleton.border_sg.select("sg_id", F.col("border").alias("vid")), ["sg_id", "vid"], "left_semi").join(asked, "query_id")
    # Every stated scenario meets every query: that is the report.
    start = entry.crossJoin(demoted).where("not (sg_id = sg and vid = out)")
    start = start.select(F.struct("sg", "out", F.col("query_id").alias("query")).alias("query_id"), "vid", "dist", "radius").groupBy("query_id", "vid").agg(F.min("dist").alias("dist"), F.max("radius").alias("radius")).where("dist <= radius")

    def ways(frontier: DataFrame) -> DataFrame:
        met = frontier.join(clique, F.col("vid") == F.col("a")).where("not (query_id.sg = sg_id and (query_id.out = a or query_id.out = b))")
        return met.select("query_id", "dist", "radius", F.col("b").alias("d"), F.col("d").alias("w"))

    reached = rounds_of(space, start, clique, None, ways=ways)
    reached = space.table(reached.select("query_id.sg", "query_id.out", F.col("query_id.query").alias("query_id"), F.col("vid").alias("border"), F.col("dist").alias("at")), "scenarios")
    placed = space.table(skeleton.placed(objects), "placed")
    touched = reached.join(skeleton.border_sg, "border").select("sg_id").distinct()
    by_border = reached.join(skeleton.border_costs(placed, touched), "border").where("not (sg_id = sg and border = out)")
    found = by_border.select("sg", "out", "query_id", "obj_id", (F.col("at") + F.col("cost")).alias("dist"))
    found = found.unionByName(skeleton.inside(queries, placed).crossJoin(demoted)).groupBy("sg", "out", "query_id", "obj_id").agg(F.min("dist").alias("now"))
    found = found.join(asked, "query_id").where("now <= radius")
    before = skeleton.object_distances(queries, placed).crossJoin(demoted)
    both = before.join(found, ["sg", "out", "query_id", "obj_id"], "left")
    changed = both.groupBy("sg", "out").agg(F.count("*").alias("results"), F.count_if(F.col("now").isNull()).alias("lost"), F.count_if(F.col("now") > F.col("dist")).alias("farther"))
    rows = demoted.join(changed, ["sg", "out"], "left").na.fill(0)
    return rows.select(F.col("sg").alias("sg_id"), F.col("out").alias("border"), "results", "lost", "farther", ((F.col("lost") == 0) & (F.col("farther") == 0)).alias("exact"))
