"""Shortest-path fields over graphs of any size, block by block of the graph.

Arcs are cut by ranges of their source into blocks of about ``BLOCK_ARCS``, one row of a table each. In a round, every block that a search has come to is searched
as far as it goes inside it, from what arrived and against what is known there; what leads out of it arrives at other blocks in the next round. So
a search takes as many rounds as it changes blocks, and a task holds the arcs of one block and the search of one query in it. No arcs go through the driver: it has the bounds of the blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Workspace

BLOCK_ARCS = 1 << 18
#: Rounds after which tables of what is known are merged.
MERGE = 8
ROWS = "array<struct<a:bigint,b:bigint,c:bigint>>"
KNOWN, ARRIVED, CUT = 0, 1, 2


def triples(a: str, b: str, c: Column | str) -> Column:
    """A list of rows of three whole numbers, of a group."""
    return F.collect_list(F.struct(*(F.col(x).cast("bigint").alias(n) if isinstance(x, str) else x.cast("bigint").alias(n) for n, x in zip("abc", (a, b, c)))))


def ranges(frame: DataFrame, key: Column | str, n: int, size: int) -> np.ndarray:
    """Where ranges of a whole number begin (but for the first) that have about ``size`` of the frame's ``n`` rows each."""
    parts = -(-n // size)
    cuts = frame.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else []
    return np.unique(np.array(cuts or [], dtype=np.int64))


def range_of(key: Column | str, cuts: np.ndarray) -> Column:
    """The number of the range that a whole number lies in."""
    if not len(cuts):
        return F.lit(0)

    @F.pandas_udf("int")
    def number(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy(), "right").astype(np.int32))

    return number(key)


def places(v: np.ndarray) -> np.ndarray:
    """Nodes below 0 lie beside the vertex that they stand for, -1 - node: a way by hubs does not change blocks at each."""
    return np.where(v < 0, -1 - v, v)


class Blocks:
    """Arcs by block."""

    def __init__(self, arcs: DataFrame, n: int, space: Workspace) -> None:
        self.cuts = ranges(arcs, self.place("s"), n, BLOCK_ARCS)
        self.space = space
        self.table = space.table(arcs.groupBy(self.of("s").alias("block")).agg(triples("s", "d", "w").alias("rows")), "blocks")

    @staticmethod
    def place(vid: str) -> Column:
        return F.when(F.col(vid) < 0, -1 - F.col(vid)).otherwise(F.col(vid))

    def of(self, vid: str) -> Column:
        return range_of(self.place(vid), self.cuts)


class Block:
    """Arcs of one block: its own vertices numbered by rank, behind them those that its arcs lead out to."""

    def __init__(self, s: np.ndarray, d: np.ndarray, w: np.ndarray, number: int, cuts: np.ndarray) -> None:
        home = np.searchsorted(cuts, places(d), "right") == number
        self.vertex = np.unique(np.concatenate([s, d[home]]))
        self.outer = np.unique(d[~home])
        order = np.argsort(s, kind="stable")
        self.start = np.searchsorted(s[order], np.append(self.vertex, np.iinfo(np.int64).max)).tolist()
        to = np.where(home, np.searchsorted(self.vertex, d), len(self.vertex) + np.searchsorted(self.outer, d))
        self.to, self.weight = to[order].tolist(), w[order].tolist()
        self.names = np.concatenate([self.vertex, self.outer])

    def search(self, vid: np.ndarray, dist: np.ndarray, radius: int, known: np.ndarray, least: np.ndarray, cuts: bool) -> tuple[np.ndarray, np.ndarray, list, list]:
        """(vertices nearer than known, their distances, ways out (vertex, distance), arcs cut by the radius (from, to, distance))."""
        n = len(self.vertex)
        limit = dict(zip(known.tolist(), least.tolist()))
        best: dict[int, int] = {}
        alone: dict[int, int] = {}
        ranks = np.searchsorted(self.vertex, vid)
        for k, v, d in zip(ranks.tolist(), vid.tolist(), dist.tolist()):
            if d > radius or d >= limit.get(v, d + 1):
                continue
            if k == n or self.vertex[k] != v:  # without arcs, so it leads nowhere
                alone[v] = min(d, alone.get(v, d))
            elif d < best.get(k, d + 1):
                best[k] = d
        heap = [(d, k) for k, d in best.items()]
        heapq.heapify(heap)
        start, to, weight, names = self.start, self.to, self.weight, self.names
        if limit:
            at = np.searchsorted(self.vertex, known)
            at[at == n] = 0
            ours = self.vertex[at] == known if n else np.zeros(len(known), bool)
            bound = dict(zip(at[ours].tolist(), least[ours].tolist()))
        else:
            bound = {}
        out: dict[int, int] = {}
        cut: list[tuple[int, int, int]] = []
        while heap:
            here, k = heapq.heappop(heap)
            if here > best[k]:
                continue
            for j in range(start[k], start[k + 1]):
                x, far = to[j], here + weight[j]
                if far > radius:
                    if cuts:
                        cut.append((k, x, far))
                elif x >= n:
                    if far < out.get(x, far + 1):
                        out[x] = far
                elif far < best.get(x, far + 1) and far < bound.get(x, far + 1):
                    best[x] = far
                    heapq.heappush(heap, (far, x))
        found = np.concatenate([names[np.fromiter(best.keys(), np.int64, len(best))], np.fromiter(alone.keys(), np.int64, len(alone))])
        far = np.fromiter([*best.values(), *alone.values()], np.int64, len(best) + len(alone))
        return found, far, [(int(names[x]), d) for x, d in out.items()], [(int(names[k]), int(names[x]), d) for k, x, d in cut]


def _numbers(scalar: pa.Scalar | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if scalar is None or not scalar.is_valid or not len(scalar.values):
        return (np.zeros(0, np.int64),) * 3
    return tuple(scalar.values.field(c).to_numpy() for c in "abc")


def search_blocks(space: Workspace, blocks: Blocks, start: DataFrame, given: DataFrame | None = None, cuts: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(query_id, vid, dist) of what ``start(query_id, vid, dist, radius)`` reaches within the radius, and arcs that lead farther: (query_id, tail, vid, dist).

    Vertices of ``given(query_id, vid, dist)`` count only with less than that distance.
    """
    kind = start.schema["query_id"].dataType.simpleString()
    session = start.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    key, bounds = ["query_id", "block"], blocks.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs, block, at = None, None, None
        for batch in batches:
            out: list[tuple] = []
            held = 0

            def flush() -> pa.RecordBatch:
                lists = [np.stack(r[4], 1).astype(np.int64) if len(r[4][0]) else np.zeros((0, 3), np.int64) for r in out]
                flat = np.concatenate(lists)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], names=list("abc"))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
                ids = pa.array([r[1] for r in out], batch.schema.field("query_id").type)
                return pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32()), ids, pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int64()), pa.ListArray.from_arrays(offsets, fields)],
                    ["kind", "query_id", "block", "radius", "rows"],
                )

            names = batch.schema.names
            number, part, asks, ids, radii, rows, known = (batch.column(names.index(c)) for c in ("block", "slice", "asks", "query_id", "radius", "rows", "known"))
            for i in range(batch.num_rows):
                b = number[i].as_py()
                if not asks[i].as_py():
                    arcs, block, at = rows[i], None, (b, part[i].as_py())
                    continue
                if at != (b, part[i].as_py()):  # a block without arcs
                    arcs, block, at = None, None, (b, part[i].as_py())
                if block is None:  # only where a query asks, since a share may have none
                    arcs, block = None, Block(*_numbers(arcs), b, bounds)
                q, radius = ids[i].as_py(), radii[i].as_py()
                vid, dist, _ = _numbers(rows[i])
                old, least, mark = _numbers(known[i])
                found, far, onward, cut = block.search(vid, dist, radius, old, least, cuts)
                if not len(found):
                    continue
                keep = ~np.isin(old, found)
                out.append((KNOWN, q, b, radius, (np.concatenate([old[keep], found]), np.concatenate([least[keep], far]), np.concatenate([mark[keep], np.zeros(len(found), np.int64)]))))
                if onward:
                    v, d = np.array(onward, dtype=np.int64).T
                    to = np.searchsorted(bounds, places(v), "right")
                    for other in np.unique(to).tolist():
                        here = to == other
                        out.append((ARRIVED, q, other, radius, (v[here], d[here], np.zeros(int(here.sum()), np.int64))))
                if cut:
                    out.append((CUT, q, b, radius, tuple(np.array(cut, dtype=np.int64).T)))
                held += len(old) + len(found) + len(onward) + len(cut)
                if held > 100_000:
                    yield flush()
                    out, held = [], 0
            if out:
                yield flush()

    def latest(tables: list[DataFrame]) -> DataFrame:
        if len(tables) == 1:
            return tables[0]
        every = tables[0].withColumn("turn", F.lit(0))
        for k, t in enumerate(tables[1:], 1):
            every = every.unionByName(t.withColumn("turn", F.lit(k)))
        return every.groupBy(*key).agg(F.max_by("rows", "turn").alias("rows"))

    arrived = start.where("dist <= radius").withColumn("block", blocks.of("vid")).groupBy(*key).agg(triples("vid", "dist", F.lit(0)).alias("rows"), F.max("radius").alias("radius"))
    known, shed, made = [], [], []
    if given is not None:
        marked = given.withColumn("block", blocks.of("vid")).groupBy(*key).agg(triples("vid", "dist", F.lit(1)).alias("rows"))
        known.append(space.table(marked, "known"))
    arrived = space.table(arrived, "arrived")
    while True:
        old = latest([k.join(arrived.select(*key).distinct(), key, "left_semi") for k in known]) if known else arrived.select(*key, "rows").limit(0)
        asked = arrived.groupBy(*key).agg(F.flatten(F.collect_list("rows")).alias("rows"), F.max("radius").alias("radius"))
        asked = asked.join(old.withColumnRenamed("rows", "known"), key, "left")
        per = shares(arrived.select(*key).distinct(), parts)
        asked = asked.join(per, "block").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.col("slices")).cast("int"))
        arcs = blocks.table.join(per, "block").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("query_id", kind), ("radius", "bigint"), ("known", ROWS))]
        columns = ["block", "slice", "asks", "query_id", "radius", "rows", "known"]
        dealt = arcs.select("block", "slice", F.lit(False).alias("asks"), "rows", *none).select(*columns).unionByName(asked.withColumn("asks", F.lit(True)).select(*columns))
        dealt = dealt.repartition(parts, "block", "slice").sortWithinPartitions("block", "slice", "asks")
        step = space.table(dealt.mapInArrow(run, f"kind int, query_id {kind}, block int, radius bigint, rows {ROWS}"), "step")
        made.append(step)
        known.append(step.where(F.col("kind") == KNOWN).select(*key, "rows"))
        if cuts:
            shed.append(step.where(F.col("kind") == CUT).select("query_id", "rows"))
        arrived = step.where(F.col("kind") == ARRIVED).select(*key, "radius", "rows")
        if arrived.isEmpty():
            break
        if len(known) > MERGE:
            known = [space.table(latest(known), "known")]
            if cuts:
                shed = [space.table(_union(shed), "cut")]
            space.drop(*made[:-1])  # what arrives is in the last one
            made = made[-1:]
    found = space.table(latest(known).select("query_id", F.explode("rows").alias("r")).where("r.c = 0").select("query_id", F.col("r.a").alias("vid"), F.col("r.b").alias("dist")), "found")
    if not cuts:
        return found, None
    rows = _union(shed).select("query_id", F.explode("rows").alias("r")).groupBy("query_id", F.col("r.a").alias("tail"), F.col("r.b").alias("vid")).agg(F.min("r.c").alias("dist"))
    rows = rows.join(found, ["query_id", "vid"], "left_anti")
    if given is not None:
        rows = rows.join(given, ["query_id", "vid"], "left_anti")
    return found, rows.select("query_id", "tail", "vid", "dist")


def shares(asked: DataFrame, parts: int) -> DataFrame:
    """(block, slices): a block that many of ``asked(query_id, block)`` ask is sent to several tasks, each with a share of them.

    Arcs are sent about as often as there are tasks, ``parts``, and no oftener than they are asked.
    """
    per = asked.groupBy("block").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("block", F.least("n", F.ceil(F.col("n") * parts / F.col("total"))).cast("int").alias("slices"))  # one row


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
