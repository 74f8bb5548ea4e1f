"""Bounded shortest-path fields for many queries at once.

``distances`` has three plans with the same result, and ``Growing`` is the same for searches whose radius grows: what lies
within a radius is settled for good, the arcs that lead out of it are kept as a table, and a larger radius starts there.

* ``fixpoint``: semi-naive rounds of joins. The frontier meets the arcs on the vertex, candidates are combined by
  minimum before their shuffle, and only what improved goes into the next round. The radius bounds each
  round's join. Each round writes its improvements as a table in the shared folder, so lineage stays one round long, and every
  ``MERGE`` rounds these are merged into one.
* ``local``: one job. The graph's arcs, if there are at most ``LOCAL_ARCS`` of them (counted first), go to every
  task as arrays, and each task runs its queries' searches on a heap. Queries are dealt out to as many tasks as there are shuffle partitions.
* ``blocks``: searches inside blocks of the graph, in rounds (see ``blocks``).

``auto`` counts the arcs and picks ``local`` where they fit, else ``blocks``, and so does ``local`` itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, search_blocks
from .work import Workspace

#: At most so many arcs are sent to every task, by way of the driver: 24 bytes each.
LOCAL_ARCS = 1 << 18
FAR = np.iinfo(np.int64).max
#: Rounds after which tables of improvements are merged.
MERGE = 8


class Adjacency:
    """Arcs sorted by source, with vertices numbered by rank."""

    def __init__(self, arcs: pd.DataFrame) -> None:
        arcs = arcs.sort_values(["s", "d"])
        self.vertex = np.unique(arcs[["s", "d"]].to_numpy(dtype=np.int64))
        self.start = np.searchsorted(arcs["s"].to_numpy(), np.append(self.vertex, FAR))
        self.to = np.searchsorted(self.vertex, arcs["d"].to_numpy())
        self.weight = arcs["w"].to_numpy(dtype=np.int64)

    def search(self, seeds: list[tuple[int, int]], radius: int, behind: list[int] = (), limits: list[tuple[int, int]] = ()) -> tuple[dict[int, int], list[tuple[int, int, int]]]:
        """Distances of all vertices within the radius, from seeds (vertex, distance), and the ways out: (from, to, distance there).

        Vertices in ``behind`` are settled already and not entered; those in ``limits`` (vertex, distance) count only with less.
        """
        heap, out = [], []
        known = dict.fromkeys(np.searchsorted(self.vertex, np.asarray(behind, dtype=np.int64)).tolist(), -1)
        if limits:
            known.update(zip(np.searchsorted(self.vertex, np.array([v for v, _ in limits], dtype=np.int64)).tolist(), (d for _, d in limits)))
        best, alone, kept = dict(known), {}, {*behind, *(v for v, _ in limits)}
        for vertex, distance in seeds:
            k = int(np.searchsorted(self.vertex, vertex))
            if k == len(self.vertex) or self.vertex[k] != vertex:  # without arcs, so it leads nowhere
                if distance <= radius and vertex not in kept:
                    alone[vertex] = min(distance, alone.get(vertex, FAR))
            elif distance <= radius and distance < best.get(k, FAR):
                best[k] = distance
                heap.append((distance, k))
        heapq.heapify(heap)
        start, to, weight = self.start, self.to, self.weight
        while heap:
            distance, k = heapq.heappop(heap)
            if distance > best[k]:
                continue
            a, b = start[k], start[k + 1]
            for n, w in zip(to[a:b].tolist(), weight[a:b].tolist()):
                far = distance + w
                if far > radius:
                    if n not in best:
                        out.append((k, n, far))
                elif far < best.get(n, FAR):
                    best[n] = far
                    heapq.heappush(heap, (far, n))
        for k, d in known.items():
            if best[k] == d:
                del best[k]
        return alone | {int(self.vertex[k]): d for k, d in best.items()}, [(int(self.vertex[k]), int(self.vertex[n]), far) for k, n, far in out if n not in best]


class Roads:
    """Arcs that several searches share: counted once and, where they fit, sent to the tasks once."""

    def __init__(self, arcs: DataFrame, method: str = "auto") -> None:
        self.arcs, self.method, self.sent, self.blocks = arcs, method, None, None
        if method == "fixpoint":
            return
        n = arcs.count()
        self.method = "local" if method != "blocks" and n <= LOCAL_ARCS else "blocks"
        if self.method == "local":
            self.sent = arcs.sparkSession.sparkContext.broadcast(Adjacency(arcs.select("s", "d", "w").toArrow().to_pandas()))
        else:
            self.blocks = Blocks(arcs.select("s", "d", "w"), n, Workspace(arcs.sparkSession, "blocks"))


def distances(seeds: DataFrame, arcs: DataFrame | Roads, method: str = "auto", max_rounds: int | None = None) -> DataFrame:
    """(query_id, vid, dist) for ``seeds(query_id, vid, dist, radius)``: all vertices with dist <= radius.

    A null radius is no bound. Weights must be positive. ``Roads`` in place of arcs have their method already.
    """
    seeds = seeds.select("query_id", "vid", F.col("dist").cast("bigint").alias("dist"), F.coalesce(F.col("radius").cast("bigint"), F.lit(int(FAR) // 4)).alias("radius"))
    roads = arcs if isinstance(arcs, Roads) else Roads(arcs, method)
    if roads.method == "blocks":
        return search_blocks(Workspace(seeds.sparkSession, "search"), roads.blocks, seeds)[0]
    return _local(seeds, roads) if roads.method == "local" else _fixpoint(seeds, roads.arcs, max_rounds)


def origins(seeds: DataFrame, arcs: DataFrame | Roads, method: str = "auto") -> DataFrame:
    """(query_id, vid, dist, origin): as ``distances``, with the seed vertex that each vertex is reached from; of equal ways the smaller one."""
    # Each seed is a search of its own; the best of a vertex is an aggregate.
    kind = seeds.schema["query_id"].dataType
    split = seeds.withColumn("key", F.concat_ws(" ", F.col("query_id").cast("string"), F.col("vid").cast("string")))
    split = split.groupBy("key").agg(F.first("query_id").alias("of"), F.first("vid").alias("vid"), F.min("dist").alias("dist"), F.max("radius").alias("radius"))
    found = distances(split.withColumnRenamed("key", "query_id"), arcs, method)
    parts = F.split("query_id", " ")
    found = found.select(parts[0].cast(kind).alias("query_id"), "vid", "dist", parts[1].cast("bigint").alias("origin"))
    return found.groupBy("query_id", "vid").agg(F.min(F.struct("dist", "origin")).alias("best")).select("query_id", "vid", "best.dist", "best.origin")


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key to as many tasks as there are shuffle partitions, which adaptive execution leaves as they are: few rows may be much work."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


class Growing:
    """Searches whose radius grows. Each vertex of a query is settled once, by the call of ``grow`` whose radius first reaches it.

    ``ways`` (query_id, tail, vid, dist) leads out of what is settled: arcs cut by the radius, at first the seeds (without a tail). With positive weights,
    roads in both directions and everything within the radius settled, a way back into it begins at a tail, so a search that does not enter tails
    settles only what is new.
    """

    def __init__(self, seeds: DataFrame, roads: Roads, space: Workspace) -> None:
        self.roads, self.space = roads, space
        self.kind = seeds.schema["query_id"].dataType.simpleString()
        tail = F.lit(None).cast("bigint").alias("tail")
        self.ways = space.table(seeds.select("query_id", tail, F.col("vid").cast("bigint").alias("vid"), F.col("dist").cast("bigint").alias("dist")), "ways")
        self.settled: DataFrame | None = None

    def grow(self, radius: DataFrame) -> DataFrame:
        """(query_id, vid, dist) that the searches of ``radius(query_id, radius)`` newly reach. Other searches stay where they are."""
        asked = self.ways.join(radius.select("query_id", F.col("radius").cast("bigint").alias("radius")), "query_id")
        others = self.ways.join(radius.select("query_id"), "query_id", "left_anti")
        step = {"local": self._local, "blocks": self._blocks}.get(self.roads.method, self._joins)(asked)
        self.ways = self.space.table(step.where("out").select("query_id", "tail", "vid", "dist").unionByName(others), "ways")
        return step.where("not out").select("query_id", "vid", "dist")

    def open(self) -> DataFrame:
        """(query_id) of searches that have not reached everything."""
        return self.ways.select("query_id").distinct()

    def _local(self, asked: DataFrame) -> DataFrame:
        graph = self.roads.sent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for query_id, ways, radius in batch[["query_id", "ways", "radius"]].itertuples(index=False):
                    behind = sorted({w["tail"] for w in ways if w["tail"] is not None})
                    field, out = graph.value.search([(w["vid"], w["dist"]) for w in ways], int(radius), behind)
                    out += [(w["tail"], w["vid"], w["dist"]) for w in ways if w["dist"] > radius and w["vid"] not in field]
                    n, m = len(field), len(out)
                    tail, head, far = (np.fromiter(c, np.int64, m) for c in (zip(*((w[0] or 0, *w[1:]) for w in out)) if out else ((), (), ())))
                    free = np.fromiter((w[0] is None for w in out), bool, m)
                    yield pd.DataFrame({
                        "query_id": query_id,
                        "tail": pd.arrays.IntegerArray(np.append(np.zeros(n, np.int64), tail), np.append(np.ones(n, bool), free)),
                        "vid": np.append(np.fromiter(field.keys(), np.int64, n), head),
                        "dist": np.append(np.fromiter(field.values(), np.int64, n), far),
                        "out": np.arange(n + m) >= n,
                    })

        grouped = spread(asked, "query_id").groupBy("query_id").agg(F.collect_list(F.struct("tail", "vid", "dist")).alias("ways"), F.max("radius").alias("radius"))
        return self.space.table(grouped.mapInPandas(run, f"query_id {self.kind}, tail long, vid long, dist long, out boolean"), "grown")

    def _blocks(self, asked: DataFrame) -> DataFrame:
        key = ["query_id", "vid"]
        asked = self.space.table(asked, "asked")
        behind = asked.where("tail is not null").select("query_id", F.col("tail").alias("vid"), F.lit(-1).cast("bigint").alias("dist")).distinct()
        found, cut = search_blocks(self.space, self.roads.blocks, asked.select(*key, "dist", "radius"), self.space.table(behind, "behind"), cuts=True)
        later = asked.where("dist > radius").select("query_id", "tail", "vid", "dist").join(found, key, "left_anti")
        new = found.select("query_id", F.lit(None).cast("bigint").alias("tail"), "vid", "dist", F.lit(False).alias("out"))
        return self.space.table(new.unionByName(cut.unionByName(later).withColumn("out", F.lit(True))), "grown")

    def _joins(self, asked: DataFrame) -> DataFrame:
        key = ["query_id", "vid"]
        known = self.settled if self.settled is not None else asked.select("query_id", "vid", "dist").limit(0)
        start = asked.where("dist <= radius").groupBy(*key).agg(F.min("dist").alias("dist"), F.max("radius").alias("radius"))
        fresh = rounds_of(self.space, start, self.roads.arcs, known)
        self.settled = self.space.table(known.unionByName(fresh), "settled")
        reach = asked.select("query_id", "radius").distinct()
        cut = fresh.join(reach, "query_id").join(self.roads.arcs, F.col("vid") == F.col("s"))
        cut = cut.where("dist + w > radius").select("query_id", F.col("vid").alias("tail"), F.col("d").alias("vid"), (F.col("dist") + F.col("w")).alias("dist"))
        out = cut.unionByName(asked.where("dist > radius").select("query_id", "tail", "vid", "dist")).join(self.settled, key, "left_anti")
        new = fresh.select("query_id", F.lit(None).cast("bigint").alias("tail"), "vid", "dist", F.lit(False).alias("out"))
        return self.space.table(new.unionByName(out.withColumn("out", F.lit(True))), "grown")


def to_targets(seeds: DataFrame, arcs: DataFrame, targets: DataFrame, method: str = "auto", nearest: int | None = None) -> DataFrame:
    """(query_id, vid, dist) of ``targets(query_id, vid)`` alone: the radius doubles until a query's targets are settled or it reaches no more.

    A distance within the radius is final; only queries with a target left go on, from where they stopped. With ``nearest``, a query ends once so
    many of its targets are settled: these are the nearest ones, with all that are as near.
    """
    space = Workspace(seeds.sparkSession, "targets")
    arc = arcs.agg(F.max("w").alias("longest"), F.ceil(F.avg("w")).alias("mean")).first()
    first, roads = seeds.agg(F.max("dist")).first()[0] or 0, Roads(arcs, method)
    left = space.table(targets.distinct(), "targets")
    if nearest is not None:
        return _nearest_targets(space, seeds, roads, left, nearest, arc.longest or 1, 2 * (arc.mean or 1) + first)
    grown, radius, out = Growing(seeds, roads, space), 2 * (arc.longest or 1) + first, None
    while True:
        now = left.select("query_id").distinct().withColumn("radius", F.lit(radius).cast("bigint"))
        found = space.table(grown.grow(now).join(left, ["query_id", "vid"], "left_semi"), "found")
        out = found if out is None else out.unionByName(found)
        left = space.table(left.join(found, ["query_id", "vid"], "left_anti").join(grown.open(), "query_id", "left_semi"), "left")
        if left.isEmpty():
            return out
        radius *= 2


def _nearest_targets(space: Workspace, seeds: DataFrame, roads: Roads, left: DataFrame, nearest: int, longest: int, radius: int) -> DataFrame:
    """Few targets are near, so searches that have too few begin again at twice the radius: that is less than to keep the ways out of all of them.

    A search whose farthest vertex is more than the longest arc within its radius has reached everything.
    """
    out = None
    while True:
        now = seeds.select("query_id", "vid", "dist").join(left.select("query_id").distinct(), "query_id", "left_semi").withColumn("radius", F.lit(radius).cast("bigint"))
        field = space.table(distances(now, roads), "field")
        met = space.table(field.join(left, ["query_id", "vid"], "left_semi"), "met")
        state = left.groupBy("query_id").agg(F.count("*").alias("targets")).join(met.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
        state = state.join(field.groupBy("query_id").agg(F.max("dist").alias("far")), "query_id")
        going = space.table(state.where((F.coalesce("n", F.lit(0)) < F.least("targets", F.lit(nearest))) & (F.col("far") + longest > radius)).select("query_id"), "going")
        done = met.join(going, "query_id", "left_anti")
        out = done if out is None else out.unionByName(done)
        if going.isEmpty():
            return out
        left = space.table(left.join(going, "query_id", "left_semi"), "left")
        radius *= 2


def _local(seeds: DataFrame, roads: Roads) -> DataFrame:
    graph = roads.sent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query_id, starts, radius in batch[["query_id", "seeds", "radius"]].itertuples(index=False):
                field = graph.value.search([(s["vid"], s["dist"]) for s in starts], int(radius))[0]
                yield pd.DataFrame({"query_id": query_id, "vid": np.fromiter(field.keys(), np.int64, len(field)), "dist": np.fromiter(field.values(), np.int64, len(field))})

    grouped = spread(seeds, "query_id").groupBy("query_id").agg(F.collect_list(F.struct("vid", "dist")).alias("seeds"), F.max("radius").alias("radius"))
    kind = seeds.schema["query_id"].dataType.simpleString()
    return grouped.mapInPandas(run, f"query_id {kind}, vid long, dist long")


def _fixpoint(seeds: DataFrame, arcs: DataFrame, max_rounds: int | None) -> DataFrame:
    space = Workspace(seeds.sparkSession, "fixpoint")
    start = seeds.where("dist <= radius").groupBy("query_id", "vid").agg(F.min("dist").alias("dist"), F.max("radius").alias("radius"))
    return rounds_of(space, start, arcs, None, max_rounds)


def search_on(space: Workspace, start: DataFrame, roads: Roads, settled: DataFrame, bounds: DataFrame) -> DataFrame:
    """(query_id, vid, dist) of what ``start(query_id, vid, dist, radius)`` reaches within the radius outside ``settled(query_id, vid)`` and below ``bounds(query_id, vid, dist)``."""
    if roads.method == "blocks":
        given = settled.select("query_id", "vid", F.lit(-1).cast("bigint").alias("dist")).unionByName(bounds.select("query_id", "vid", "dist"))
        return search_blocks(space, roads.blocks, start, given)[0]
    if roads.method != "local":
        return rounds_of(space, start, roads.arcs, settled, bounds=bounds)
    graph, kind = roads.sent, start.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query_id, rows, radius in batch[["query_id", "rows", "radius"]].itertuples(index=False):
                of: list[list[tuple[int, int]]] = [[], [], []]
                for r in rows:
                    of[r["part"]].append((r["vid"], r["dist"]))
                field = graph.value.search(of[0], int(radius), [v for v, _ in of[1]], of[2])[0] if of[0] else {}
                yield pd.DataFrame({"query_id": query_id, "vid": np.fromiter(field.keys(), np.int64, len(field)), "dist": np.fromiter(field.values(), np.int64, len(field))})

    none = F.lit(None).cast("bigint")
    parts = [start.select("query_id", F.lit(0).alias("part"), "vid", "dist", "radius"), settled.select("query_id", F.lit(1).alias("part"), "vid", F.lit(0).cast("bigint").alias("dist"), none.alias("radius"))]
    parts.append(bounds.select("query_id", F.lit(2).alias("part"), "vid", "dist", none.alias("radius")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    grouped = spread(rows, "query_id").groupBy("query_id").agg(F.collect_list(F.struct("part", "vid", "dist")).alias("rows"), F.max("radius").alias("radius")).where("radius is not null")
    return grouped.mapInPandas(run, f"query_id {kind}, vid long, dist long")


def rounds_of(
    space: Workspace, start: DataFrame, arcs: DataFrame, settled: DataFrame | None, max_rounds: int | None = None,
    bounds: DataFrame | None = None, ways: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(query_id, vid, dist) of what ``start(query_id, vid, dist, radius)`` reaches within the radius outside ``settled``.

    With ``bounds(query_id, vid, dist)`` only distances below these count, and with ``ways`` a frontier is joined with its arcs (as s, d, w) by that.
    """
    key = ["query_id", "vid"]
    limits = None if bounds is None else bounds.select(*key, F.col("dist").alias("limit"))

    def allowed(step: DataFrame) -> DataFrame:
        if settled is not None:
            step = step.join(settled, key, "left_anti")
        return step if limits is None else step.join(limits, key, "left").where("limit is null or dist < limit").drop("limit")

    frontier = space.table(allowed(start), "better")
    better, rounds = [frontier], 0

    def best(tables: list[DataFrame], of: DataFrame | None = None) -> DataFrame:
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        rows = rows if of is None else rows.join(of.select(*key), key, "left_semi")
        return rows.groupBy(*key).agg(F.min("dist").alias("dist"), F.max("radius").alias("radius"))

    while True:
        met = frontier.join(arcs, F.col("vid") == F.col("s")) if ways is None else ways(frontier)
        step = met.select("query_id", F.col("d").alias("vid"), (F.col("dist") + F.col("w")).alias("dist"), "radius")
        step = step.where("dist <= radius").groupBy(*key).agg(F.min("dist").alias("dist"), F.max("radius").alias("radius"))
        step = space.table(allowed(step), "step")
        known = best(better, step).select(*key, F.col("dist").alias("known"))
        new = space.table(step.join(known, key, "left").where("known is null or dist < known").drop("known"), "better")
        space.drop(step)
        if new.isEmpty():
            return best(better).select("query_id", "vid", "dist")
        frontier, rounds = new, rounds + 1
        better.append(new)
        if len(better) > MERGE:
            merged = space.table(best(better), "best")
            space.drop(*better[:-1])  # the last one is the frontier
            better = [merged]
        if max_rounds is not None and rounds > max_rounds:
            raise ValueError(f"no fixpoint after {max_rounds} rounds: weights must be positive")
