"""Seeded objects and query workloads on a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import numbered
from ..plans.work import Workspace
from ..streaming.positions import relocate


def random_objects(edges: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` objects at seeded slots, each inner point of an edge being a slot; several may share one."""
    ids = edges.sparkSession.range(n).select(F.col("id").alias("obj_id"))
    return relocate(ids, edges, seed)


def distinct_objects(edges: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` objects at different slots; an error if there are not so many."""
    total = edges.where("w > 1").agg(F.sum(F.col("w") - 1)).first()[0] or 0
    if n > total:
        raise ValueError(f"{n} objects do not fit in {total} slots")
    slots = edges.where("w > 1").select("u", "v", "w", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("w") - 1)).alias("offset_"))
    space = Workspace(edges.sparkSession, "distinct-objects")
    # Hashes are even, so a share of them a little above what is needed has n slots or nearly; where it has fewer, all slots are ranked.
    slots = slots.withColumn("h", F.xxhash64(F.lit(seed), "u", "v", "offset_"))
    share = min(1.0, n / total + 8 * (n**0.5 + 1) / total)
    some = space.table(slots.where(F.col("h").cast("double") <= (share - 0.5) * 2.0**64), "slots")
    some = some if some.count() >= n else space.table(slots, "slots")
    ranked = numbered(some, [F.col(c) for c in ("h", "u", "v", "offset_")], "obj_id", space)
    return ranked.where(F.col("obj_id") < n).select(F.col("obj_id").cast("bigint").alias("obj_id"), "u", "v", "w", "offset_")


def laid_out(sg_edges: DataFrame, n: int, layout: str, seed: int = 7) -> DataFrame:
    """``n`` objects, ``spread`` over all subgraphs or ``clustered`` in few (max(4, min(64, all / 64)) of them).

    Each subgraph offers one preferred edge, and objects are dealt to subgraphs in turn.
    """
    edge = sg_edges.where("w > 1").groupBy("sg_id").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "u", "v").alias("h"), "u", "v", "w")).alias("e"))
    count = edge.count()
    if layout == "clustered":
        count = min(count, max(4, min(64, count // 64)))
    elif layout != "spread":
        raise ValueError(f"no such layout: {layout}")
    if not count:
        raise ValueError("no subgraph has an edge with room")
    space = Workspace(sg_edges.sparkSession, "layout")
    chosen = space.table(edge.select("sg_id", "e.u", "e.v", "e.w"), "edges")
    chosen = numbered(chosen, [F.xxhash64(F.lit(seed), "sg_id"), F.col("sg_id")], "turn", space).where(F.col("turn") < count)
    ids = edges_range(sg_edges, n).withColumn("turn", F.pmod("obj_id", F.lit(count)))
    placed = ids.join(chosen, "turn")
    return placed.select("obj_id", "u", "v", "w", (1 + F.pmod(F.xxhash64(F.lit(seed + 1), "obj_id"), F.col("w") - 1)).alias("offset_"))


def edges_range(frame: DataFrame, n: int) -> DataFrame:
    return frame.sparkSession.range(n).select(F.col("id").alias("obj_id"))


def random_queries(edges: DataFrame, n: int, radius: int | None = None, k: int | None = None, seed: int = 17) -> DataFrame:
    """``n`` seeded query positions with the same radius or k."""
    rows = random_objects(edges, n, seed).withColumnRenamed("obj_id", "query_id")
    if radius is not None:
        rows = rows.withColumn("radius", F.lit(radius).cast("bigint"))
    return rows.withColumn("k", F.lit(k)) if k is not None else rows
