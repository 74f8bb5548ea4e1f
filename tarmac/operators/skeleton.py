"""Skeleton of a partition, and range and kNN queries that search it in place of the whole graph.

The skeleton joins borders of the same subgraph by their distance inside it. A query enters through the
borders of its own subgraph, the search runs over borders only, and each subgraph it touches is
either accepted whole (all of it is near enough) or its objects are scored from its borders. Every
way from a query to an object either stays in one subgraph or passes a border of the
object's subgraph, so both cases are unioned and the result equals the whole-graph definition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import Growing, Roads, distances
from ..plans.work import Workspace
from .partition import all_pairs, border_rows, bounds_of, distances_from, packed, rb_ib, sg_vertices, subgraphs
from .queries import first_k, objects_in


class Skeleton:
    """Tables of a partition: members, sg_dist, clique, skeleton, border_sg, bounds."""

    def __init__(self, sg_edges: DataFrame, sg_dist: DataFrame | None = None) -> None:
        self.sg_edges, self.space = sg_edges, Workspace(sg_edges.sparkSession, "skeleton")
        self._dist = sg_dist
        self.derived = sg_dist is None
        self._roads: dict[str, Roads] = {}
        self._tables: dict[str, DataFrame] | None = None
        self.members = sg_vertices(sg_edges)
        self.border_sg = self.members.where("is_border").select(F.col("vid").alias("border"), "sg_id")

    def persist(self) -> Skeleton:
        """Write out the tables that every operation reads, each from those before it, so that no plan holds their making."""
        self.sg_edges = self.space.table(self.sg_edges, "edges")
        if not self.derived:
            self._dist = self.space.table(self._dist, "distances")
        self.members = self.space.table(sg_vertices(self.sg_edges), "members")
        self.border_sg = self.space.table(self.members.where("is_border").select(F.col("vid").alias("border"), "sg_id"), "borders")
        self._tables = {}
        return self

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What operations share; written out at its first use once the skeleton is."""
        if self._tables is None:
            return make()
        if name not in self._tables:
            self._tables[name] = self.space.table(make(), name)
        return self._tables[name]

    @property
    def sg_dist(self) -> DataFrame:
        """(sg_id, a, b, d); made where it is asked for, since most operations need a part of it."""
        return self._kept("distances", lambda: all_pairs(self.sg_edges)) if self.derived else self._dist

    def packed(self) -> DataFrame:
        return self._kept("packed", lambda: packed(self.sg_edges, self.members))

    def from_borders(self) -> DataFrame:
        """(sg_id, a, b, d): distances inside subgraphs from their borders."""
        if self.derived:
            return self._kept("from-borders", lambda: border_rows(self.packed()))
        return self._kept("from-borders", lambda: self.sg_dist.join(self.border_sg.select("sg_id", F.col("border").alias("a")), ["sg_id", "a"], "left_semi").select("sg_id", "a", "b", "d"))

    def save(self, path: str) -> None:
        for name in ("sg_edges", "sg_dist"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Skeleton:
        return cls(spark.read.parquet(f"{path}/sg_edges"), spark.read.parquet(f"{path}/sg_dist"))

    def clique(self) -> DataFrame:
        """(sg_id, a, b, d): distances between borders of a subgraph."""
        b = self.border_sg.select("sg_id", F.col("border").alias("b"))
        if self.derived:
            only = self.border_sg.select("sg_id", F.col("border").alias("b"))
            return self._kept("clique", lambda: border_rows(self.packed(), only).where("a != b"))
        return self._kept("clique", lambda: self.from_borders().where("a != b").join(b, ["sg_id", "b"], "left_semi").select("sg_id", "a", "b", "d"))

    def skeleton(self) -> DataFrame:
        """(a, b, w) with a < b: the least over subgraphs."""
        return self.clique().where("a < b").groupBy("a", "b").agg(F.min("d").alias("w"))

    def sg_adjacency(self) -> DataFrame:
        """(sg_a, sg_b, shared): pairs of subgraphs a < b and how many borders they share."""
        a, b = self.border_sg.withColumnRenamed("sg_id", "sg_a"), self.border_sg.withColumnRenamed("sg_id", "sg_b")
        return a.join(b, "border").where("sg_a < sg_b").groupBy("sg_a", "sg_b").agg(F.count("*").alias("shared"))

    def bounds(self) -> DataFrame:
        if self.derived:
            return self._kept("bounds", lambda: bounds_of(self.packed()))
        return self._kept("bounds", lambda: rb_ib(self.sg_edges, self.from_borders(), self.members))

    def placed(self, objects: DataFrame) -> DataFrame:
        """Objects with their subgraph."""
        return objects if "sg_id" in objects.columns else objects_in(objects, self.sg_edges.select("sg_id", "u", "v"))

    def border_costs(self, objects: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """(obj_id, sg_id, border, cost): inside its subgraph, from each border; of the subgraphs in ``only(sg_id)`` if it is given."""
        placed = self.placed(objects)
        if only is not None:
            placed = placed.join(only, "sg_id", "left_semi")
        ends = _ends(placed, "obj_id", "b")
        to = border_rows(self.packed(), ends.select("sg_id", "b")) if self.derived else self.from_borders()
        return ends.join(to, ["sg_id", "b"]).groupBy("obj_id", "sg_id", F.col("a").alias("border")).agg(F.min(F.col("d") + F.col("more")).alias("cost"))

    def suffix(self, objects: DataFrame, costs: DataFrame | None = None) -> DataFrame:
        """(obj_id, sg_id, suffix, border): least way to any border of the subgraph, and which; from border costs if these are given."""
        costs = self.border_costs(objects) if costs is None else costs
        least = costs.groupBy("obj_id", "sg_id").agg(F.min(F.struct("cost", "border")).alias("b"))
        return least.select("obj_id", "sg_id", F.col("b.cost").alias("suffix"), F.col("b.border").alias("border"))

    def lower_bounds(self, reached: DataFrame, objects: DataFrame) -> DataFrame:
        """(query_id, obj_id, lower_bound): the nearest reached border of the object's subgraph and the object's least way to a border."""
        near = reached.join(self.border_sg, "border").groupBy("query_id", "sg_id").agg(F.min("d").alias("lb"))
        return near.join(self.suffix(objects), "sg_id").groupBy("query_id", "obj_id").agg(F.min(F.col("lb") + F.col("suffix")).alias("lower_bound"))

    def entry(self, queries: DataFrame) -> DataFrame:
        """(query_id, sg_id, vid, dist): distances inside the query's own subgraph, to all of its vertices."""
        own = queries.join(self.sg_edges.select("sg_id", "u", "v"), ["u", "v"])
        ends = _ends(own, "query_id", "a")
        inside = all_pairs(self.sg_edges.join(ends.select("sg_id").distinct(), "sg_id", "left_semi")) if self.derived else self.sg_dist
        return ends.join(inside, ["sg_id", "a"]).groupBy("query_id", "sg_id", F.col("b").alias("vid")).agg(F.min(F.col("d") + F.col("more")).cast("bigint").alias("dist"))

    def border_distances(self, queries: DataFrame, method: str = "auto", arcs: DataFrame | None = None) -> DataFrame:
        """(query_id, border, d) within ``queries.radius``: the search over the skeleton, or over other ``arcs`` between its borders (other nodes are below 0)."""
        start = self.entry(queries).join(self.border_sg.select("sg_id", F.col("border").alias("vid")), ["sg_id", "vid"], "left_semi")
        start = start.join(queries.select("query_id", "radius"), "query_id").select("query_id", "vid", "dist", "radius")
        found = distances(start, self.roads(method) if arcs is None else Roads(arcs, method)).where("vid >= 0")
        return self.space.table(found, "reached").select("query_id", F.col("vid").alias("border"), F.col("dist").alias("d"))

    def roads(self, method: str = "auto") -> Roads:
        """The skeleton as arcs, prepared once for all searches over it."""
        if method not in self._roads:
            both = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("d")), F.struct(F.col("b").alias("s"), F.col("a").alias("d")))
            self._roads[method] = Roads(self.skeleton().select("w", F.explode(both).alias("x")).select("x.s", "x.d", "w"), method)
        return self._roads[method]

    def classify(self, queries: DataFrame, reached: DataFrame) -> DataFrame:
        """Per query and touched subgraph: whether each cover rule accepts it whole.

        ``ib`` (used here): least d + IB within the radius; sound for any partition. ``ub``: the same with RB; ``paper``:
        ``ub`` and all borders reached; ``all_borders``: all reached. Those three are diagnostics.
        """
        bounds = self.bounds()
        n = self.border_sg.groupBy("sg_id").agg(F.count("*").alias("n_borders"))
        touched = reached.join(self.border_sg, "border").join(bounds, ["sg_id", "border"])
        per = touched.groupBy("query_id", "sg_id").agg(
            F.min(2 * F.col("d") + F.col("ib2")).alias("by_ib2"), F.min(2 * F.col("d") + F.col("rb2")).alias("by_rb2"), F.count("*").alias("n_reached"), F.min("d").alias("lb")
        )
        per = per.join(n, "sg_id").join(queries.select("query_id", "radius"), "query_id")
        ub = F.coalesce(F.col("by_rb2") <= 2 * F.col("radius"), F.lit(False))
        every = F.col("n_reached") == F.col("n_borders")
        return per.select("query_id", "sg_id", "lb", F.coalesce(F.col("by_ib2") <= 2 * F.col("radius"), F.lit(False)).alias("ib"), ub.alias("ub"), (ub & every).alias("paper"), every.alias("all_borders"))

    def object_distances(self, queries: DataFrame, objects: DataFrame, method: str = "auto", reached: DataFrame | None = None) -> DataFrame:
        """(query_id, obj_id, dist) within the radius, by borders and inside the query's own subgraph. Only objects of subgraphs that are reached are looked at."""
        reached = self.border_distances(queries, method) if reached is None else reached
        placed = self.placed(objects)
        touched = reached.join(self.border_sg, "border").select("sg_id").distinct()
        by_border = reached.join(self.border_costs(placed, touched), "border").select("query_id", "obj_id", (F.col("d") + F.col("cost")).alias("dist"))
        found = by_border.unionByName(self.inside(queries, placed)).groupBy("query_id", "obj_id").agg(F.min("dist").alias("dist"))
        return found.join(queries.select("query_id", "radius"), "query_id").where("dist <= radius").select("query_id", "obj_id", "dist")

    def inside(self, queries: DataFrame, placed: DataFrame, entry: DataFrame | None = None) -> DataFrame:
        """(query_id, obj_id, dist) of objects in the query's own subgraph, by ways inside it."""
        ends = _ends(placed, "obj_id", "vid")
        ways = (self.entry(queries) if entry is None else entry).join(ends, ["sg_id", "vid"]).select("query_id", "obj_id", (F.col("dist") + F.col("more")).alias("dist"))
        return ways.groupBy("query_id", "obj_id").agg(F.min("dist").alias("dist"))

    def range(self, queries: DataFrame, objects: DataFrame, method: str = "auto") -> DataFrame:
        """(query_id, obj_id): accepted subgraphs bring all their objects, the others are scored."""
        reached = self.border_distances(queries, method)
        cover = self.space.table(self.classify(queries, reached).select("query_id", "sg_id", "ib"), "cover")
        placed = self.space.table(self.placed(objects), "placed")
        whole = cover.where("ib").select("query_id", "sg_id").join(placed, "sg_id").select("query_id", "obj_id")
        rest = cover.where("not ib").select("query_id", "sg_id")
        costs = reached.join(self.border_sg, "border").join(rest, ["query_id", "sg_id"]).join(self.border_costs(placed, rest.select("sg_id").distinct()), ["sg_id", "border"])
        scored = costs.join(queries.select("query_id", "radius"), "query_id").where(F.col("d") + F.col("cost") <= F.col("radius")).select("query_id", "obj_id")
        own = self.inside(queries, placed).join(queries.select("query_id", "radius"), "query_id").where("dist <= radius").select("query_id", "obj_id")
        return whole.unionByName(scored).unionByName(own).distinct()

    def growing(self, queries: DataFrame, entry: DataFrame, method: str) -> Growing:
        """The search over borders, from those of each query's own subgraph."""
        start = entry.join(self.border_sg.select("sg_id", F.col("border").alias("vid")), ["sg_id", "vid"], "left_semi").select("query_id", "vid", "dist")
        return Growing(start, self.roads(method), self.space)

    def knn(self, queries: DataFrame, objects: DataFrame, start: int, method: str = "auto") -> DataFrame:
        """(query_id, rnk, obj_id, dist): the radius doubles, from where the search stopped, until k objects are within it or nothing more can be reached."""
        space, left, out, radius = self.space, queries.where("k > 0"), None, start
        entry, placed = space.table(self.entry(left), "entry"), space.table(self.placed(objects), "placed")
        grown = self.growing(left, entry, method)
        near = space.table(self.inside(left, placed, entry), "near")
        while True:
            fresh = grown.grow(left.select("query_id", F.lit(radius).alias("radius"))).select("query_id", F.col("vid").alias("border"), F.col("dist").alias("d"))
            touched = fresh.join(self.border_sg, "border").select("sg_id").distinct()
            found = fresh.join(self.border_costs(placed, touched), "border").select("query_id", "obj_id", (F.col("d") + F.col("cost")).alias("dist"))
            found = found.unionByName(near.join(left, "query_id", "left_semi")).groupBy("query_id", "obj_id").agg(F.min("dist").alias("dist"))
            near = space.table(found, "near")
            inside = near.where(F.col("dist") <= radius).groupBy("query_id").agg(F.count("*").alias("n"))
            state = left.select("query_id", "k").join(inside, "query_id", "left").join(grown.open().withColumn("whole", F.lit(False)), "query_id", "left")
            state = space.table(state.select("query_id", "k", (F.coalesce("n", F.lit(0)) >= F.col("k")).alias("enough"), F.coalesce("whole", F.lit(True)).alias("whole")), "state")
            done = state.where("enough or whole").join(near, "query_id").where(F.col("whole") | (F.col("dist") <= radius))
            done = space.table(first_k(done.select("query_id", "obj_id", "dist", "k"), F.col("k")), "done")
            out = done if out is None else out.unionByName(done)
            left = space.table(left.join(state.where("not enough and not whole"), "query_id", "left_semi"), "left")
            if left.isEmpty():
                return out
            radius *= 2

    def threshold_knn(self, queries: DataFrame, objects: DataFrame, start: int, method: str = "auto") -> DataFrame:
        """(query_id, rnk, obj_id, dist): objects are scored once, and only those that a sound threshold cannot rule out.

        All points of a subgraph are within d + IB of a query, for any of its borders at distance d. Taken in order of that bound, subgraphs
        weighted by how many objects they have reach k at some bound, the threshold: k objects are within it, for any partition. The
        search over borders doubles its radius until a query has a threshold and then goes on to it, once. Objects of the subgraphs in reach get
        bounds of their own, their least way to a border behind it (an upper one) and behind the nearest border of their subgraph (a lower one), which may
        lower the threshold; those whose lower bound is within it are scored. Distances inside the query's own subgraph bound it too.
        ``self.scored`` has the (query_id, obj_id) that were.
        """
        space, left, radius = self.space, queries.where("k > 0"), start
        left = space.table(left, "asked")
        entry, placed = space.table(self.entry(left), "entry"), space.table(self.placed(objects), "placed")
        weights = space.table(placed.groupBy("sg_id").agg(F.count("*").alias("n")), "weights")
        ib = self.bounds().select("sg_id", "border", "ib2")
        grown, reached, going = self.growing(left, entry, method), None, left
        done: list[DataFrame] = []  # (query_id, tau2): doubled thresholds, null where everything is in reach and there is none
        while True:
            fresh = grown.grow(going.select("query_id", F.lit(radius).alias("radius"))).select("query_id", F.col("vid").alias("border"), F.col("dist").alias("d"))
            reached = space.table(fresh if reached is None else reached.unionByName(fresh), "reached")
            touched = reached.join(going, "query_id", "left_semi").join(ib, "border").join(weights, "sg_id")
            bounds = touched.where("ib2 is not null").groupBy("query_id", "sg_id", "n").agg(F.min(2 * F.col("d") + F.col("ib2")).alias("bound"))
            state = going.select("query_id", "k").join(_threshold(bounds, going), "query_id", "left").join(grown.open().withColumn("whole", F.lit(False)), "query_id", "left")
            state = space.table(state.withColumn("whole", F.coalesce("whole", F.lit(True))), "state")
            done.append(state.where("tau2 is not null or whole").select("query_id", "tau2"))
            going = space.table(going.join(state.where("tau2 is null and not whole"), "query_id", "left_semi"), "going")
            if going.isEmpty():
                break
            radius *= 2
        tau = done[0]
        for d in done[1:]:
            tau = tau.unionByName(d)
        tau = space.table(tau, "threshold")
        on = grown.grow(tau.where("tau2 is not null").select("query_id", F.expr("(tau2 + 1) div 2").alias("radius")))
        reached = space.table(reached.unionByName(on.select("query_id", F.col("vid").alias("border"), F.col("dist").alias("d"))), "reached")

        # Bounds of single objects, in the subgraphs within the threshold.
        inside = space.table(self.inside(left, placed, entry), "inside")
        near = reached.join(self.border_sg, "border").groupBy("query_id", "sg_id").agg(F.min("d").alias("lb")).join(tau, "query_id")
        near = space.table(near.where("tau2 is null or 2 * lb <= tau2"), "near")
        suffix = space.table(self.suffix(placed.join(near.select("sg_id").distinct(), "sg_id", "left_semi")), "suffix")
        low = near.join(suffix, "sg_id").where("tau2 is null or 2 * (lb + suffix) <= tau2").select("query_id", "obj_id", "sg_id", (F.col("lb") + F.col("suffix")).alias("low"), "suffix", "border", "tau2")
        low = space.table(low, "low")
        upper = low.join(reached, ["query_id", "border"]).select("query_id", "obj_id", (2 * (F.col("d") + F.col("suffix"))).alias("bound"))
        upper = upper.unionByName(inside.select("query_id", "obj_id", (2 * F.col("dist")).alias("bound"))).groupBy("query_id", "obj_id").agg(F.min("bound").alias("bound"))
        lower = tau.join(_threshold(upper.withColumn("n", F.lit(1)), left).withColumnRenamed("tau2", "other"), "query_id", "left")
        lower = space.table(lower.select("query_id", F.least("tau2", "other").alias("tau2")), "threshold")
        asked = low.drop("tau2").join(lower, "query_id").where("tau2 is null or 2 * low <= tau2").select("query_id", "obj_id", "sg_id")
        self.scored = asked = space.table(asked, "scored")
        costs = self.border_costs(placed.join(asked.select("obj_id").distinct(), "obj_id", "left_semi"), near.select("sg_id").distinct())
        found = asked.join(costs, ["obj_id", "sg_id"]).join(reached, ["query_id", "border"]).select("query_id", "obj_id", (F.col("d") + F.col("cost")).alias("dist"))
        found = found.unionByName(inside).groupBy("query_id", "obj_id").agg(F.min("dist").alias("dist"))
        found = found.join(lower, "query_id").where("tau2 is null or 2 * dist <= tau2").select("query_id", "obj_id", "dist")
        return first_k(found.join(left.select("query_id", "k"), "query_id"), F.col("k"))


    def admitted(self, queries: DataFrame, objects: DataFrame, reached: DataFrame | None = None) -> DataFrame:
        """(query_id, sg_id, obj_id) of objects that are surely among the ``k`` nearest, by bounds of their subgraphs alone.

        Objects of a subgraph are at least as far as the nearest border reached (or nothing, for the query's own) and at most as d + IB. Those
        that could be as near as a subgraph's farthest point lie in subgraphs whose least distance is within that bound; if these hold no more than k
        objects, all of the subgraph's are among the k nearest, however ties fall. Bounds beyond ``queries.radius`` are not used, since
        subgraphs beyond it are not known.
        """
        reached = self.border_distances(queries) if reached is None else reached
        placed = self.space.table(self.placed(objects), "placed")
        weights = placed.groupBy("sg_id").agg(F.count("*").alias("n"))
        asked = queries.select("query_id", "radius", "k")
        own = queries.join(self.sg_edges.select("sg_id", "u", "v"), ["u", "v"]).select("query_id", "sg_id", F.lit(0).cast("bigint").alias("low2"), F.lit(None).cast("bigint").alias("high2"))
        met = reached.join(self.bounds().select("sg_id", "border", "ib2"), "border").select("query_id", "sg_id", (2 * F.col("d")).alias("low2"), (2 * F.col("d") + F.col("ib2")).alias("high2"))
        span = met.unionByName(own).groupBy("query_id", "sg_id").agg(F.min("low2").alias("low2"), F.min("high2").alias("high2")).join(weights, "sg_id").join(asked, "query_id")
        # Weights by where subgraphs begin, summed up to where each ends.
        ends = F.array(F.struct(F.col("low2").alias("at"), F.lit(0).alias("end"), F.col("n").alias("n")), F.struct(F.col("high2").alias("at"), F.lit(1).alias("end"), F.lit(0).cast("bigint").alias("n")))
        steps = span.select("query_id", "sg_id", "radius", "k", F.explode(ends).alias("e")).select("query_id", "sg_id", "radius", "k", "e.at", "e.end", "e.n").where("at is not null and at <= 2 * radius")
        so_far = Window.partitionBy("query_id").orderBy("at", "end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        sure = steps.withColumn("held", F.sum("n").over(so_far)).where("end = 1 and held <= k").select("query_id", "sg_id")
        return sure.join(placed, "sg_id").select("query_id", "sg_id", "obj_id")


def _ends(placed: DataFrame, key: str, name: str) -> DataFrame:
    """(key, sg_id, vertex, more): both ends of each position's edge with the way to them."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("offset_").alias("more")), F.struct(F.col("v").alias("x"), (F.col("w") - F.col("offset_")).alias("more")))
    return placed.select(key, "sg_id", F.explode(ends).alias("e")).select(key, "sg_id", F.col("e.x").alias(name), "e.more")


def _threshold(bounds: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, tau2): the least bound within which ``bounds(query_id, bound, n)`` hold ``k``; no row where they hold fewer."""
    so_far = Window.partitionBy("query_id").orderBy("bound").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = bounds.join(queries.select("query_id", "k"), "query_id").withColumn("held", F.sum("n").over(so_far))
    return held.where("held >= k").groupBy("query_id").agg(F.min("bound").alias("tau2"))


def hub_arcs(skeleton: Skeleton, to: DataFrame) -> DataFrame:
    """(s, d, w): ways border to hub to border where ``to(sg_id, a, hub, d)`` has hubs for a subgraph, and clique rows elsewhere.

    The node of hub h is -1 - h. One vertex is one node in all subgraphs that it serves, since ways through it are ways of the graph.
    """
    space = skeleton.space
    clique = skeleton.clique().join(to.select("sg_id").distinct(), "sg_id", "left_anti").groupBy("a", "b").agg(F.min("d").alias("w")).select(F.col("a").alias("s"), F.col("b").alias("d"), "w")
    way = to.groupBy("a", "hub").agg(F.min("d").alias("w")).select("a", (-1 - F.col("hub")).alias("node"), "w")
    both = F.array(F.struct(F.col("a").alias("s"), F.col("node").alias("d")), F.struct(F.col("node").alias("s"), F.col("a").alias("d")))
    return space.table(clique.unionByName(way.select("w", F.explode(both).alias("x")).select("x.s", "x.d", "w")), "hub-arcs")


def group_subgraphs(adjacency: DataFrame, most: int) -> DataFrame:
    """(sg_id, parent): groups of up to ``most`` neighbouring subgraphs, breadth first from the smallest id.

    Runs in one task over the subgraph adjacency, which is far smaller than the graph.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in pdf[["sg_a", "sg_b"]].itertuples(index=False):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        parent: dict[int, int] = {}
        for first in sorted(near):
            if first in parent:
                continue
            group, queue = [first], [first]
            parent[first] = first
            while queue and len(group) < most:
                for n in sorted(near[queue.pop(0)]):
                    if n not in parent and len(group) < most:
                        parent[n] = first
                        group.append(n)
                        queue.append(n)
        return pd.DataFrame(sorted(parent.items()), columns=["sg_id", "parent"])

    return adjacency.groupBy(F.lit(0).alias("one")).applyInPandas(run, "sg_id long, parent long")


def hubs(skeleton: Skeleton, least_borders: int = 12, ratio: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Clique rows through hubs: (sg_id, a, hub, d) and (sg_id, hub, b, d), for subgraphs where that saves arcs.

    A hub lies exactly between the borders it serves. Hubs are picked greedily by how many uncovered pairs they
    serve; a subgraph keeps them if it has enough borders and hub arcs are at most ``ratio`` of its pairs.
    """
    names, kinds = ["sg_id", "a", "hub", "d"], "sg_id long, a long, hub long, d long"

    def picked(sg_id: int, vertex: np.ndarray, at: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        rows = _serving(at, far, least_borders, ratio)
        b, h = rows if rows is not None else (np.zeros(0, np.int64),) * 2
        return [np.full(len(b), sg_id, dtype=np.int64), vertex[at[b]], vertex[h], far[b, h]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [picked(sg_id, vertex, at, distances_from(u, v, w, len(vertex), at)) for sg_id, vertex, u, v, w, at, _ in subgraphs(batch) if len(at) >= least_borders]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)

    def run_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        border, a = np.unique(pdf["a"].to_numpy(), return_inverse=True)
        vertex, b = np.unique(np.concatenate([pdf["b"].to_numpy(), border]), return_inverse=True)
        far = np.full((len(border), len(vertex)), -1, dtype=np.int64)
        far[a, b[: len(a)]] = pdf["d"].to_numpy()
        return pd.DataFrame(dict(zip(names, picked(int(pdf["sg_id"].iloc[0]), vertex, b[len(a) :], far))))

    to = skeleton.packed().mapInArrow(run, kinds) if skeleton.derived else skeleton.from_borders().groupBy("sg_id").applyInPandas(run_rows, kinds)
    return to, to.select("sg_id", "hub", F.col("a").alias("b"), "d")


def _serving(at: np.ndarray, far: np.ndarray, least_borders: int, ratio: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(borders, hubs) by number, from distances of borders (rows, which are the vertices ``at``) to all vertices, -1 where there is no way; None without saving."""
    if len(at) < least_borders:
        return None
    a, b = np.triu_indices(len(at), 1)
    d = far[a, at[b]]
    a, b, d = a[d >= 0], b[d >= 0], d[d >= 0]

    def served(pairs: np.ndarray) -> np.ndarray:
        """How many of some pairs each vertex lies between."""
        n = np.zeros(far.shape[1], np.int64)
        for some in np.array_split(pairs, -(-len(pairs) * len(n) // 1_000_000) or 1):
            x, y = far[a[some]], far[b[some]]
            n += ((x >= 0) & (y >= 0) & (x + y == d[some, None])).sum(axis=0)
        return n

    left = np.ones(len(d), bool)
    n, kept, held = served(np.arange(len(d))), [], 0
    while left.any():
        hub = int(n.argmax())
        x, y = far[a, hub], far[b, hub]
        got = np.flatnonzero(left & (x >= 0) & (y >= 0) & (x + y == d))
        ends = np.unique(np.concatenate([a[got], b[got]]))
        held += len(ends)
        if not len(got) or held > ratio * len(d):
            return None
        kept.append((ends, np.full(len(ends), hub)))
        left[got] = False
        n -= served(got)
    return (np.concatenate([e for e, _ in kept]), np.concatenate([h for _, h in kept])) if kept else None
