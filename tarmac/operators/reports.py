"""Audits, sweeps and diagnostics: aggregates over partitions, skeletons and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graph
from .partition import nearest_border, rb_ib, sg_vertices
from .queries import objects_in
from .skeleton import Skeleton


def size_histogram(sg_edges: DataFrame, width: int = 10) -> DataFrame:
    """(bucket, n): subgraphs by number of vertices, in buckets of ``width``."""
    sizes = sg_vertices(sg_edges).groupBy("sg_id").agg(F.count("*").alias("size"))
    return sizes.groupBy(F.expr(f"size div {width} * {width}").cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def partition_audit(edges: DataFrame, sg_edges: DataFrame, sg_dist: DataFrame | None = None) -> DataFrame:
    """One row: counts, coverage (missing, ghost and doubly owned edges) and how many borders break BR."""
    key = ["u", "v"]
    owners = sg_edges.groupBy(*key).agg(F.count("*").alias("owners"))
    cover = edges.select(*key, F.lit(1).alias("is_edge")).join(owners, key, "full_outer")
    coverage = cover.agg(
        F.count("is_edge").alias("graph_edges"),
        F.count_if(F.col("owners").isNull()).alias("missing_edges"),
        F.count_if(F.col("is_edge").isNull()).alias("ghost_edges"),
        F.count_if(F.col("owners") > 1).alias("shared_edges"),
    )
    members = sg_vertices(sg_edges)
    sizes = members.groupBy("sg_id").agg(F.count("*").alias("n"), F.count_if("is_border").alias("b"))
    shape = sizes.agg(F.count("*").alias("subgraphs"), F.max("n").alias("max_vertices"), F.sum("b").alias("border_slots"), F.sum(F.col("n") - F.col("b")).alias("internal_vertices"))
    bounds = Skeleton(sg_edges).persist().bounds() if sg_dist is None else rb_ib(sg_edges, sg_dist, members)
    br = bounds.agg(F.count_if(~F.col("br_ok")).alias("br_broken"), F.countDistinct("border").alias("borders"))
    return coverage.crossJoin(shape).crossJoin(br)  # three rows of one


def weight_audit(before: DataFrame, after: DataFrame, sg_edges: DataFrame) -> DataFrame:
    """BR before and after weights changed, with the same ownership."""
    rows = []
    for name, edges in (("before", before), ("after", after)):
        owned = sg_edges.select("sg_id", "u", "v").join(edges, ["u", "v"]).select("sg_id", "u", "v", "w")
        bounds = Skeleton(owned).persist().bounds()
        rows.append(bounds.agg(F.count("*").alias("borders"), F.count_if(~F.col("br_ok")).alias("br_broken")).select(F.lit(name).alias("state"), "borders", "br_broken"))
    return rows[0].unionByName(rows[1])


def coverage(result: DataFrame, objects: DataFrame, sg_edges: DataFrame) -> DataFrame:
    """Per query, of an exact result: touched subgraphs, those wholly in the result, and objects of either kind."""
    placed = objects_in(objects, sg_edges).select("obj_id", "sg_id")
    per = placed.groupBy("sg_id").agg(F.count("*").alias("total"))
    hit = result.join(placed, "obj_id").groupBy("query_id", "sg_id").agg(F.count("*").alias("inside")).join(per, "sg_id")
    whole = F.col("inside") == F.col("total")
    return hit.groupBy("query_id").agg(
        F.count("*").alias("touched"), F.count_if(whole).alias("full"),
        F.sum("inside").alias("result_objects"), F.sum(F.when(whole, F.col("inside")).otherwise(0)).alias("full_objects"),
    )


def coverage_compare(result: DataFrame, objects: DataFrame, partitions: dict[str, DataFrame]) -> DataFrame:
    """The ratio of sums over queries for each partition."""
    rows = None
    for name, sg_edges in partitions.items():
        per = coverage(result, objects, sg_edges).agg(F.sum("touched").alias("touched"), F.sum("full").alias("full"), F.sum("result_objects").alias("result_objects"), F.sum("full_objects").alias("full_objects"))
        one = per.select(F.lit(name).alias("method"), "touched", "full", "result_objects", "full_objects", F.round(F.col("full_objects") / F.col("result_objects"), 6).alias("object_ratio"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def border_topology(sg_edges: DataFrame) -> DataFrame:
    """(border, subgraphs, inside_degree, external_degree) of each border in each subgraph."""
    border = sg_vertices(sg_edges).where("is_border").select("sg_id", "vid")
    ends = sg_edges.select("sg_id", F.explode(F.array("u", "v")).alias("vid"))
    inside = ends.groupBy("sg_id", "vid").agg(F.count("*").alias("inside_degree"))
    everywhere = ends.groupBy("vid").agg(F.count("*").alias("degree"), F.countDistinct("sg_id").alias("subgraphs"))
    rows = border.join(inside, ["sg_id", "vid"]).join(everywhere, "vid")
    return rows.select("sg_id", F.col("vid").alias("border"), "subgraphs", "inside_degree", (F.col("degree") - F.col("inside_degree")).alias("external_degree"))


def border_slack(skeleton: Skeleton) -> DataFrame:
    """(sg_id, border, slack2, witnesses): doubled RB - IB, and how many borders are as far as RB."""
    bounds = skeleton.bounds()
    clique = skeleton.clique().groupBy("sg_id", "a", "d").agg(F.count("*").alias("n"))
    most = clique.groupBy("sg_id", "a").agg(F.max(F.struct("d", "n")).alias("m")).select("sg_id", F.col("a").alias("border"), F.col("m.n").alias("witnesses"))
    return bounds.join(most, ["sg_id", "border"], "left").select("sg_id", "border", (F.col("rb2") - F.col("ib2")).alias("slack2"), F.coalesce("witnesses", F.lit(0)).alias("witnesses"))


def nearest_other_border(skeleton: Skeleton) -> DataFrame:
    return skeleton.clique().groupBy("sg_id", F.col("a").alias("border")).agg(F.min("d").alias("nearest"))


def exposure(reached: DataFrame, border_sg: DataFrame) -> DataFrame:
    """(border, touches, first_rank, pairs): how many queries reach a border, its best rank in one, its (query, subgraph) pairs."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("d", "border")
    ranked = reached.withColumn("rank", F.row_number().over(order))
    n = border_sg.groupBy("border").agg(F.count("*").alias("subgraphs"))
    per = ranked.groupBy("border").agg(F.count("*").alias("touches"), F.min("rank").alias("first_rank"))
    return per.join(n, "border").select("border", "touches", F.col("first_rank").cast("bigint").alias("first_rank"), (F.col("touches") * F.col("subgraphs")).alias("pairs"))


def hotspots(reached: DataFrame, border_sg: DataFrame) -> DataFrame:
    """(sg_id, events, share): subgraphs by their share of border visits."""
    per = reached.join(border_sg, "border").groupBy("sg_id").agg(F.count("*").alias("events"))
    total = per.agg(F.sum("events").alias("all_events"))
    return per.crossJoin(F.broadcast(total)).select("sg_id", "events", F.round(F.col("events") / F.col("all_events"), 6).alias("share"))  # one row


def demotable(sg_edges: DataFrame, members: DataFrame) -> DataFrame:
    """Marked borders that only one subgraph touches: candidates to be demoted."""
    shared = sg_vertices(sg_edges).where("is_border").select("sg_id", "vid")
    return members.where("is_border").select("sg_id", "vid").join(shared, ["sg_id", "vid"], "left_anti")


def ghost_edges(edges: DataFrame, sg_edges: DataFrame) -> DataFrame:
    return sg_edges.join(edges, ["u", "v"], "left_anti")


def memory_report(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(structure, n, bytes): rows of each table times the bytes that one takes."""
    rows = None
    for name, (df, width) in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("structure"), "n", (F.col("n") * width).alias("bytes"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def md_audit(sg_dist: DataFrame, members: DataFrame, stored: DataFrame) -> DataFrame:
    """Vertices whose stored nearest-border distance is not what the tables give."""
    fresh = nearest_border(sg_dist, members)
    joined = fresh.join(stored.select("sg_id", "vid", F.col("md").alias("stored")), ["sg_id", "vid"], "full_outer")
    return joined.where(~F.col("md").eqNullSafe(F.col("stored")))


def sweep(skeleton: Skeleton, queries: DataFrame, objects: DataFrame, radii: list[int]) -> DataFrame:
    """Per radius, summed over queries: results, touched subgraphs and those that each cover rule accepts."""
    wide = queries.drop("radius").withColumn("radius", F.explode(F.array(*[F.lit(r).cast("bigint") for r in radii])))
    # Each (query, radius) is a query of its own.
    renamed = wide.withColumn("base", F.col("query_id")).withColumn("query_id", F.col("query_id") * F.lit(1_000_000) + F.col("radius"))
    renamed = skeleton.space.table(renamed, "sweep")
    reached = skeleton.border_distances(renamed)
    cover = skeleton.classify(renamed, reached).join(renamed.select("query_id", "radius"), "query_id")
    accepted = cover.groupBy("radius").agg(F.count("*").alias("touched"), *[F.count_if(c).alias(c) for c in ("ib", "ub", "paper", "all_borders")])
    found = skeleton.object_distances(renamed, objects, reached=reached).join(renamed.select("query_id", "radius"), "query_id").groupBy("radius").agg(F.count("*").alias("results"))
    return accepted.join(found, "radius", "left").na.fill(0)


def batch_sizes(found: DataFrame, queries: DataFrame, radii: list[int]) -> DataFrame:
    """(radius, queries, least, most, mean): result sizes of a batch at several radii, from distances at the widest."""
    wanted = queries.select("query_id", F.explode(F.array(*[F.lit(r).cast("bigint") for r in radii])).alias("radius"))
    inside = found.select("query_id", "obj_id", "dist").join(wanted, "query_id").where("dist <= radius").groupBy("query_id", "radius").agg(F.count("*").alias("n"))
    sizes = wanted.join(inside, ["query_id", "radius"], "left").na.fill(0, ["n"])
    return sizes.groupBy("radius").agg(F.count("*").alias("queries"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def batch_distances(found: DataFrame, ks: list[int]) -> DataFrame:
    """(k, results, nearest, farthest, mean): distances of a batch of kNN queries for several k, from the results for the largest."""
    rows = found.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rnk <= k")
    return rows.groupBy("k").agg(F.count("*").alias("results"), F.min("dist").alias("nearest"), F.max("dist").alias("farthest"), F.round(F.avg("dist"), 6).alias("mean"))


def settled(field: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, vid, dist, settled, relaxed): the order in which a search settles vertices, and the arcs it tries at each."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("dist", "vid")
    ranked = field.withColumn("settled", F.row_number().over(order).cast("bigint"))
    return ranked.join(graph.degrees(edges).select("vid", F.col("degree").alias("relaxed")), "vid").select("query_id", "vid", "dist", "settled", "relaxed")


def external_edges(sg_edges: DataFrame) -> DataFrame:
    """(sg_id, external_edges, through): edges of other subgraphs at a subgraph's borders (an edge at two of them twice), and at how many borders."""
    border = sg_vertices(sg_edges).where("is_border").select("sg_id", "vid")
    ends = sg_edges.select(F.col("sg_id").alias("owner"), F.explode(F.array("u", "v")).alias("vid"))
    met = border.join(ends, "vid").where("owner != sg_id")
    return met.groupBy("sg_id").agg(F.count("*").alias("external_edges"), F.count_distinct("vid").alias("through"))


def edge_length_report(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("edges"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.round(F.avg("w"), 6).alias("mean_w"), F.countDistinct("w").alias("distinct_w"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return graph.degrees(edges).groupBy("degree").agg(F.count("*").alias("vertices"))
