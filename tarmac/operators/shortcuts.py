"""Shortcuts between subgraphs some steps apart: exact ways between representative borders, which searches take in one arc.

The representative of a subgraph is the border with the least sum of distances to its other borders. Added arcs are as long as the
way between their ends, so no distance changes; a search by rounds of joins needs fewer rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import to_targets
from ..plans.work import Workspace
from .skeleton import Skeleton


def representatives(skeleton: Skeleton) -> DataFrame:
    """(sg_id, rep): of equal sums the smaller border; where no border reaches all others, the smallest border."""
    n = skeleton.border_sg.groupBy("sg_id").agg(F.count("*").alias("n"), F.min("border").alias("first"))
    sums = skeleton.clique().groupBy("sg_id", "a").agg(F.sum("d").alias("total"), F.count("*").alias("reached")).join(n, "sg_id").where("reached = n - 1")
    best = sums.groupBy("sg_id").agg(F.min(F.struct("total", "a")).alias("best"))
    return n.join(best, "sg_id", "left").select("sg_id", F.coalesce("best.a", "first").alias("rep"))


def apart(adjacency: DataFrame, steps: int, space: Workspace) -> DataFrame:
    """(sg_id, other): pairs of subgraphs exactly so many steps apart, in both directions, from ``adjacency(sg_a, sg_b)``."""
    both = F.array(F.struct(F.col("sg_a").alias("sg_id"), F.col("sg_b").alias("other")), F.struct(F.col("sg_b").alias("sg_id"), F.col("sg_a").alias("other")))
    near = space.table(adjacency.select(F.explode(both).alias("p")).select("p.sg_id", "p.other").distinct(), "near")
    onward = near.select(F.col("sg_id").alias("other"), F.col("other").alias("next"))
    ring = seen = near
    for _ in range(steps - 1):
        found = ring.join(onward, "other").where("next != sg_id").select("sg_id", F.col("next").alias("other")).distinct()
        ring = space.table(found.join(seen, ["sg_id", "other"], "left_anti"), "ring")
        seen = seen.unionByName(ring)
    return ring


def shortcuts(skeleton: Skeleton, steps: int, per: int, method: str = "auto") -> DataFrame:
    """(sg_a, sg_b, a, b, w): from each subgraph's representative to those of the ``per`` nearest subgraphs that are ``steps`` steps apart."""
    space = skeleton.space
    rep = space.table(representatives(skeleton), "representatives")
    pairs = apart(skeleton.sg_adjacency(), steps, space)
    pairs = pairs.join(rep.withColumnRenamed("rep", "a"), "sg_id").join(rep.select(F.col("sg_id").alias("other"), F.col("rep").alias("b")), "other").where("a != b")
    pairs = space.table(pairs, "pairs")
    seeds = pairs.select(F.col("sg_id").alias("query_id"), F.col("a").alias("vid"), F.lit(0).cast("bigint").alias("dist")).distinct()
    found = to_targets(seeds, skeleton.roads(method).arcs, pairs.select(F.col("sg_id").alias("query_id"), F.col("b").alias("vid")), method, per)
    found = pairs.join(found.select(F.col("query_id").alias("sg_id"), F.col("vid").alias("b"), F.col("dist").alias("w")), ["sg_id", "b"])
    nearest = Window.partitionBy("sg_id").orderBy("w", "other")
    found = found.withColumn("turn", F.row_number().over(nearest)).where(F.col("turn") <= per)
    return found.select(F.col("sg_id").alias("sg_a"), F.col("other").alias("sg_b"), "a", "b", "w")


def with_shortcuts(arcs: DataFrame, added: DataFrame) -> DataFrame:
    """(s, d, w): arcs and shortcuts in both directions, each pair once with its least weight."""
    both = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("d")), F.struct(F.col("b").alias("s"), F.col("a").alias("d")))
    more = added.select("w", F.explode(both).alias("x")).select("x.s", "x.d", "w")
    return arcs.select("s", "d", "w").unionByName(more).groupBy("s", "d").agg(F.min("w").alias("w"))
