"""Edge partitions of a graph, their border vertices and bounds.

Every edge belongs to one subgraph (``sg_edges(sg_id, u, v, w)``); vertices with edges in several are borders.
Halves (middles of edges) are kept as doubled whole numbers: ``rb2``, ``ib2``.

* ``sg_dist(sg_id, a, b, d)``: distances inside a subgraph, including d(a, a) = 0; no row means unreachable.
* RB of a border: the largest distance to another border of its subgraph. IB: how far any point of the
  subgraph can be from it. BR holds if RB >= IB for each border.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graph
from ..plans.blocks import range_of, ranges
from ..plans.fixpoint import spread
from ..plans.work import Workspace


def own_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edge ownership from a vertex assignment ``parts(vid, part)``.

    An edge inside a part belongs to it. A cut edge goes to the part of its end with fewer cut edges; equal
    ends go to the part of ``u``, which is stable under any order of rows.
    """
    pu = parts.select(F.col("vid").alias("u"), F.col("part").alias("part_u"))
    pv = parts.select(F.col("vid").alias("v"), F.col("part").alias("part_v"))
    both = edges.join(pu, "u").join(pv, "v")
    cut = both.where("part_u != part_v").select(F.explode(F.array("u", "v")).alias("vid")).groupBy("vid").agg(F.count("*").alias("cut"))
    cu, cv = cut.select(F.col("vid").alias("u"), F.col("cut").alias("cut_u")), cut.select(F.col("vid").alias("v"), F.col("cut").alias("cut_v"))
    ranked = both.join(cu, "u", "left").join(cv, "v", "left")
    to_v = (F.col("part_u") != F.col("part_v")) & (F.col("cut_v") < F.col("cut_u"))
    return ranked.select(F.when(to_v, F.col("part_v")).otherwise(F.col("part_u")).cast("bigint").alias("sg_id"), "u", "v", "w")


def sg_vertices(sg_edges: DataFrame) -> DataFrame:
    """(sg_id, vid, is_border): a border has edges in more than one subgraph."""
    ends = sg_edges.select("sg_id", F.explode(F.array("u", "v")).alias("vid")).distinct()
    shared = ends.groupBy("vid").agg(F.count("*").alias("n"))
    return ends.join(shared, "vid").select("sg_id", "vid", (F.col("n") > 1).alias("is_border"))


def borders(sg_edges: DataFrame) -> DataFrame:
    return sg_vertices(sg_edges).where("is_border").select("sg_id", "vid")


#: Subgraphs of at most so many vertices are solved as one dense block; larger ones by a search from each vertex.
DENSE = 256


def _dense(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    far = np.full((n, n), np.inf)
    np.minimum.at(far, (u, v), w)
    far = np.minimum(far, far.T)
    np.fill_diagonal(far, 0)
    for k in range(n):
        np.minimum(far, far[:, k, None] + far[k], out=far)
    return far


def _searched(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, starts: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(vertex, vertices it reaches, distances), one vertex after another."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in zip(u.tolist(), v.tolist(), w.tolist()):
        near[a].append((b, c))
        near[b].append((a, c))
    for start in range(n) if starts is None else starts:
        best, heap = {}, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if x not in best:
                best[x] = d
                for y, c in near[x]:
                    if y not in best:
                        heapq.heappush(heap, (d + c, y))
        yield start, np.fromiter(best.keys(), np.int64, len(best)), np.fromiter(best.values(), np.int64, len(best))


def _pairs(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    # Floats are exact up to 2^53.
    if n <= DENSE and int(w.sum()) < 1 << 53:
        far = _dense(u, v, w, n)
        a, b = np.nonzero(np.isfinite(far))
        yield a, b, far[a, b].astype(np.int64)
    else:
        for start, to, far in _searched(u, v, w, n):
            yield np.full(len(to), start), to, far


def _all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["sg_id", "a", "b", "d"])

    for batch in batches:
        parts: list[tuple[np.ndarray, ...]] = []
        for sg_id, edges in zip(batch.column(0).to_pylist(), batch.column(1)):
            u, v, w = (edges.values.field(c).to_numpy() for c in ("u", "v", "w"))
            vertex, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
            for a, b, d in _pairs(ends[: len(u)], ends[len(u) :], w, len(vertex)):
                parts.append((np.full(len(a), sg_id, dtype=np.int64), vertex[a], vertex[b], d))
                if sum(len(p[0]) for p in parts) > 200_000:
                    yield out(parts)
                    parts = []
        if parts:
            yield out(parts)


def all_pairs(sg_edges: DataFrame) -> DataFrame:
    """(sg_id, a, b, d) inside each subgraph; subgraphs are small by construction, and run in parallel."""
    packed = spread(sg_edges, "sg_id").groupBy("sg_id").agg(F.collect_list(F.struct("u", "v", "w")).alias("edges"))
    return packed.mapInArrow(_all_pairs, "sg_id long, a long, b long, d long")


def packed(sg_edges: DataFrame, members: DataFrame) -> DataFrame:
    """(sg_id, edges, borders): a row for each subgraph, from which tasks work out distances, so that these need not be shuffled."""
    edges = spread(sg_edges, "sg_id").groupBy("sg_id").agg(F.collect_list(F.struct("u", "v", "w")).alias("edges"))
    border = members.where("is_border").groupBy("sg_id").agg(F.collect_list("vid").alias("borders"))
    return edges.join(border, "sg_id", "left")


def distances_from(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """Distances from some vertices to all, -1 where there is no way."""
    out = np.full((len(starts), n), -1, dtype=np.int64)
    if n <= DENSE and int(w.sum()) < 1 << 53:
        far = _dense(u, v, w, n)[starts]
        out[np.isfinite(far)] = far[np.isfinite(far)].astype(np.int64)
    else:
        for k, (_, to, far) in enumerate(_searched(u, v, w, n, starts.tolist())):
            out[k, to] = far
    return out


def subgraphs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(sg_id, vertices, ends u, ends v, w, borders, row of the batch), vertices numbered by rank."""
    names = batch.schema.names
    for i, (sg_id, edges, border) in enumerate(zip(*(batch.column(names.index(c)) for c in ("sg_id", "edges", "borders")))):
        u, v, w = (edges.values.field(c).to_numpy() for c in ("u", "v", "w"))
        vertex, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        at = np.searchsorted(vertex, np.sort(border.values.to_numpy())) if border.is_valid else np.zeros(0, np.int64)
        yield sg_id.as_py(), vertex, ends[: len(u)], ends[len(u) :], w, at, i


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for sg_id, vertex, u, v, w, at, _ in subgraphs(batch):
            far = distances_from(u, v, w, len(vertex), at)
            for k, b in enumerate(vertex[at].tolist()):
                rb2 = 2 * int(far[k, at].max()) if (far[k, at] >= 0).all() else None
                ib2 = int((far[k, u] + far[k, v] + w).max()) if (far[k, u] >= 0).all() and (far[k, v] >= 0).all() else None
                rows.append((sg_id, b, rb2, ib2, rb2 is not None and ib2 is not None and rb2 >= ib2))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["sg_id", "border", "rb2", "ib2", "br_ok"])


def bounds_of(subgraphs: DataFrame) -> DataFrame:
    """As ``rb_ib``, from ``packed`` subgraphs: nothing is shuffled."""
    return subgraphs.mapInArrow(_bounds, "sg_id long, border long, rb2 long, ib2 long, br_ok boolean")


def _border_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, held = [], 0
        only = batch.column(batch.schema.names.index("only")) if "only" in batch.schema.names else None
        for sg_id, vertex, u, v, w, at, i in subgraphs(batch):
            to = np.arange(len(vertex))
            if only is not None:
                to = to[np.isin(vertex, only[i].values.to_numpy())]
            for some in np.array_split(at, -(-len(at) * len(vertex) // 1_000_000) or 1):
                far = distances_from(u, v, w, len(vertex), some)[:, to]
                a, b = np.nonzero(far >= 0)
                parts.append((np.full(len(a), sg_id, dtype=np.int64), vertex[some[a]], vertex[to[b]], far[a, b]))
                held += len(a)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["sg_id", "a", "b", "d"])
                    parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["sg_id", "a", "b", "d"])


def border_rows(subgraphs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(sg_id, a, b, d) from borders of ``packed`` subgraphs to all of their vertices, or to those of ``only(sg_id, b)``."""
    if only is not None:
        subgraphs = subgraphs.join(only.groupBy("sg_id").agg(F.collect_set("b").alias("only")), "sg_id")
    return subgraphs.mapInArrow(_border_rows, "sg_id long, a long, b long, d long")


def insert_edge(sg_dist: DataFrame, new: DataFrame) -> DataFrame:
    """``sg_dist`` after one edge for each subgraph in ``new(sg_id, u, v, w)`` was added between its vertices."""
    to = sg_dist.join(new, "sg_id")
    by_u = to.where("b = u").select("sg_id", F.col("a").alias("x"), "u", "v", "w", F.col("d").alias("du"))
    by_v = to.where("b = v").select("sg_id", F.col("a").alias("x"), F.col("d").alias("dv"))
    ends = by_u.join(by_v, ["sg_id", "x"])
    far = ends.select("sg_id", F.col("x").alias("y"), F.col("du").alias("eu"), F.col("dv").alias("ev"))
    ways = ends.join(far, "sg_id").select("sg_id", F.col("x").alias("a"), F.col("y").alias("b"), F.least(F.col("du") + F.col("w") + F.col("ev"), F.col("dv") + F.col("w") + F.col("eu")).alias("d"))
    return sg_dist.unionByName(ways).groupBy("sg_id", "a", "b").agg(F.min("d").alias("d"))


def add_leaf(sg_dist: DataFrame, leaf: DataFrame) -> DataFrame:
    """``sg_dist`` after a new vertex hangs on an old one: ``leaf(sg_id, attach, vid, w)``."""
    out = sg_dist.join(leaf, (sg_dist["sg_id"] == leaf["sg_id"]) & (sg_dist["b"] == leaf["attach"])).select(sg_dist["sg_id"], "a", F.col("vid").alias("b"), (F.col("d") + F.col("w")).alias("d"))
    own = leaf.select("sg_id", F.col("vid").alias("a"), F.col("vid").alias("b"), F.lit(0).cast("bigint").alias("d"))
    return sg_dist.unionByName(out).unionByName(out.select("sg_id", F.col("b").alias("a"), F.col("a").alias("b"), "d")).unionByName(own)


def rb_ib(sg_edges: DataFrame, sg_dist: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(sg_id, border, rb2, ib2, br_ok), doubled. Null means unbounded: part of the subgraph is not reached."""
    members = sg_vertices(sg_edges) if members is None else members
    edge_of = members.where("is_border").select("sg_id", F.col("vid").alias("border"))
    others = edge_of.select("sg_id", F.col("border").alias("b"))
    n_borders = edge_of.groupBy("sg_id").agg(F.count("*").alias("n_borders"))
    from_border = sg_dist.join(edge_of.withColumnRenamed("border", "a"), ["sg_id", "a"], "left_semi")
    rb = from_border.join(others, ["sg_id", "b"], "left_semi").groupBy("sg_id", F.col("a").alias("border")).agg(F.max("d").alias("rb"), F.count("*").alias("reached"))
    du = from_border.select("sg_id", F.col("a").alias("border"), F.col("b").alias("u"), F.col("d").alias("du"))
    dv = from_border.select("sg_id", F.col("a").alias("border"), F.col("b").alias("v"), F.col("d").alias("dv"))
    middle = sg_edges.join(du, ["sg_id", "u"]).join(dv, ["sg_id", "border", "v"])
    ib = middle.groupBy("sg_id", "border").agg(F.max(F.col("du") + F.col("dv") + F.col("w")).alias("ib2"), F.count("*").alias("edges_reached"))
    n_edges = sg_edges.groupBy("sg_id").agg(F.count("*").alias("n_edges"))
    all_rows = edge_of.join(rb, ["sg_id", "border"], "left").join(ib, ["sg_id", "border"], "left").join(n_borders, "sg_id").join(n_edges, "sg_id")
    out = all_rows.select(
        "sg_id", "border",
        F.when(F.col("reached") == F.col("n_borders"), 2 * F.col("rb")).alias("rb2"),
        F.when(F.col("edges_reached") == F.col("n_edges"), F.col("ib2")).alias("ib2"),
    )
    return out.withColumn("br_ok", F.coalesce(F.col("rb2") >= F.col("ib2"), F.lit(False)))


def nearest_border(sg_dist: DataFrame, members: DataFrame) -> DataFrame:
    """(sg_id, vid, md): distance of each vertex to the nearest border of its subgraph; 0 on borders."""
    b = members.where("is_border").select("sg_id", F.col("vid").alias("a"))
    return sg_dist.join(b, ["sg_id", "a"], "left_semi").groupBy("sg_id", F.col("b").alias("vid")).agg(F.min("d").alias("md"))


def distal_point(d1, d2, w):
    """Doubled distance of the farthest point of an edge whose ends are at ``d1`` and ``d2``."""
    return d1 + d2 + w


def minimize_borders(sg_edges: DataFrame, sg_dist: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with borders demoted that no other subgraph touches, while BR still holds and two remain.

    Only pinned borders can be demoted: those marked although all of their edges are in the subgraph.
    """
    true_borders = sg_vertices(sg_edges).where("is_border").select("sg_id", "vid", F.lit(True).alias("shared"))
    rows = members.join(true_borders, ["sg_id", "vid"], "left").select("sg_id", "vid", "is_border", F.coalesce("shared", F.lit(False)).alias("shared"))

    grouped = sg_dist.groupBy("sg_id").agg(F.collect_list(F.struct("a", "b", "d")).alias("dist"))
    owned = sg_edges.groupBy("sg_id").agg(F.collect_list(F.struct("u", "v", "w")).alias("own"))
    packed = rows.groupBy("sg_id").agg(F.collect_list(F.struct("vid", "is_border", "shared")).alias("rows")).join(grouped, "sg_id").join(owned, "sg_id")

    def run(batches):
        for batch in batches:
            out = []
            for sg_id, listed, dist, own in batch[["sg_id", "rows", "dist", "own"]].itertuples(index=False):
                d = {(r["a"], r["b"]): r["d"] for r in dist}
                marked = {r["vid"] for r in listed if r["is_border"]}

                def holds(now: set[int]) -> bool:
                    for b in now:
                        rb2 = 2 * max((d.get((b, o), -1) for o in now), default=0)
                        far = [d.get((b, e["u"]), None) for e in own]
                        if None in far or any(rb2 < d[b, e["u"]] + d[b, e["v"]] + e["w"] for e in own):
                            return False
                    return True

                for r in sorted(listed, key=lambda r: r["vid"]):
                    if r["is_border"] and not r["shared"] and len(marked) > 2 and holds(marked - {r["vid"]}):
                        marked.discard(r["vid"])
                out += [(sg_id, r["vid"], r["vid"] in marked) for r in listed]
            yield pd.DataFrame(out, columns=["sg_id", "vid", "is_border"])

    return packed.mapInPandas(run, "sg_id long, vid long, is_border boolean")


def block_parts(edges: DataFrame, size: int, shift: int = 0) -> DataFrame:
    """A vertex assignment by runs of ``size`` vertex numbers: for networks numbered along their layout."""
    return graph.vertices(edges).select("vid", F.expr(f"cast((vid - 1 + {shift}) div {size} as bigint)").alias("part"))


#: Edges that are grown, and subgraphs that are merged, in one task, about.
GROWN_EDGES = 1 << 15
MERGED_SUBGRAPHS = 1 << 15
#: Subgraphs grown from a range of vertices are numbered from its number times this.
RANGE_IDS = 1 << 32


def grow_parts(edges: DataFrame, theta: int, seed: int = 1) -> DataFrame:
    """``sg_edges`` grown subgraph by subgraph, each in distance order up to ``theta`` vertices.

    A growth step is kept only if each border still reaches as far along borders as any point inside
    (RB >= IB); then unowned edges between present vertices join, lightest first, under the same test.
    Growth depends on what earlier subgraphs took. It runs by ranges of ``u`` of about ``GROWN_EDGES`` edges, a task each, in which a vertex
    with edges elsewhere is a border; a graph of one range is grown as a whole.
    """
    cuts = ranges(edges, "u", edges.count(), GROWN_EDGES)
    degree = edges.select(F.explode(F.array("u", "v")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n"))
    of = [degree.select(F.col("vid").alias(x), F.col("n").alias(f"n_{x}")) for x in "uv"]
    dealt = edges.select("u", "v", "w").join(of[0], "u").join(of[1], "v").withColumn("range", range_of("u", cuts))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _grow(pdf, theta, seed)
        return out.assign(sg_id=out["sg_id"] + int(pdf["range"].iloc[0]) * RANGE_IDS)

    return spread(dealt, "range").groupBy("range").applyInPandas(run, "sg_id long, u long, v long, w long")


def _grow(pdf: pd.DataFrame, theta: int, seed: int) -> pd.DataFrame:
    near: dict[int, dict[int, int]] = defaultdict(dict)
    degree: dict[int, int] = {}
    for u, v, w, n_u, n_v in pdf[["u", "v", "w", "n_u", "n_v"]].itertuples(index=False):
        near[u][v] = near[v][u] = w
        degree[u], degree[v] = n_u, n_v
    free = {v: set(n) for v, n in near.items()}
    order = sorted(near, key=lambda v: ((v * 2654435761 + seed) % 1000003, v))
    out: list[tuple[int, int, int, int]] = []
    sg_id = 0
    for start in order:
        while free[start]:
            own = _one(start, near, free, theta, degree)
            for u, v in own:
                free[u].discard(v)
                free[v].discard(u)
                out.append((sg_id, u, v, near[u][v]))
            sg_id += 1
    return pd.DataFrame(out, columns=["sg_id", "u", "v", "w"])


def _one(start: int, near: dict, free: dict, theta: int, degree: dict) -> list[tuple[int, int]]:
    """Edges of one subgraph grown from a vertex over edges that no other has."""
    inside, own, heap = {start}, [], []
    for y in free[start]:
        heapq.heappush(heap, (near[start][y], y, start))
    waiting: list[tuple[int, int]] = []
    while heap and len(inside) < theta:
        d, y, x = heapq.heappop(heap)
        edge = (min(x, y), max(x, y))
        if y in inside:
            if edge not in own:
                waiting.append(edge)
            continue
        if own and not _reaches(own + [edge], near, degree):
            continue
        own.append(edge)
        inside.add(y)
        for z in free[y]:
            if (min(y, z), max(y, z)) not in own:
                heapq.heappush(heap, (d + near[y][z], z, y))
    for edge in sorted({(min(x, y), max(x, y)) for x in inside for y in free[x] if y in inside} - set(own), key=lambda e: (near[e[0]][e[1]], e)):
        if _reaches(own + [edge], near, degree):
            own.append(edge)
    return own


def _reaches(own: list[tuple[int, int]], near: dict, degree: dict) -> bool:
    local: dict[int, list[int]] = defaultdict(list)
    for u, v in own:
        local[u].append(v)
        local[v].append(u)
    edge = [v for v in local if len(local[v]) < degree[v] or degree[v] == 1]
    for b in edge:
        best, heap = {b: 0}, [(0, b)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for y in local[x]:
                if d + near[x][y] < best.get(y, d + near[x][y] + 1):
                    best[y] = d + near[x][y]
                    heapq.heappush(heap, (best[y], y))
        if 2 * max(best[o] for o in edge) < max(best[u] + best[v] + near[u][v] for u, v in own):
            return False
    return True


def merge_small(sg_edges: DataFrame, theta: int, small: int = 3) -> DataFrame:
    """Subgraphs of at most ``small`` vertices joined with neighbours that share a vertex, up to ``theta`` vertices.

    Pairs are taken lightest shared vertex first by union-find with a capacity, by ranges of the subgraphs' smallest vertices, a task each, to which only
    the sizes and the touching pairs of small subgraphs go. Pairs of different ranges follow in rounds of joins: those that are the first one left of both of
    their subgraphs merge, until none fits.
    """
    space = Workspace(sg_edges.sparkSession, "merge")
    sg_edges = space.table(sg_edges.select("sg_id", "u", "v", "w"), "edges")
    ends = sg_edges.select("sg_id", F.explode(F.array("u", "v")).alias("vid")).distinct()
    sizes = space.table(ends.groupBy("sg_id").agg(F.count("*").alias("n"), F.min("vid").alias("first")), "sizes")
    cuts = ranges(sizes, "first", sizes.count(), MERGED_SUBGRAPHS)
    placed = ends.join(sizes.select("sg_id", "n", range_of("first", cuts).alias("range")), "sg_id")
    left, right = (placed.select(F.col("sg_id").alias(x), "vid", F.col("n").alias(f"n_{x}"), F.col("range").alias(f"range_{x}")) for x in "ab")
    touch = space.table(left.where(F.col("n_a") <= small).join(right, "vid").where("a != b"), "touching")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root, size = {}, {}
        for a, b, na, nb in pdf[["a", "b", "n_a", "n_b"]].itertuples(index=False):
            root[a], root[b], size[a], size[b] = a, b, na, nb

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b, _ in sorted(pdf[["a", "b", "vid"]].itertuples(index=False, name=None), key=lambda r: (r[2], r[0], r[1])):
            x, y = sorted((find(a), find(b)))
            if x != y and size[x] + size[y] - 1 <= theta:
                root[y] = x
                size[x] += size[y] - 1
        return pd.DataFrame([(x, find(x), size[find(x)]) for x in root], columns=["sg_id", "into", "n"])

    inside = spread(touch.where("range_a = range_b").withColumnRenamed("range_a", "range"), "range")
    moves = space.table(inside.groupBy("range").applyInPandas(run, "sg_id long, into long, n long"), "moves")
    into = moves.select("sg_id", "into")
    if len(cuts):
        into = _merge_across(space, touch.where("range_a != range_b"), moves, theta)
    return sg_edges.join(into, "sg_id", "left").select(F.coalesce("into", "sg_id").alias("sg_id"), "u", "v", "w")


def _merge_across(space: Workspace, pairs: DataFrame, moves: DataFrame, theta: int) -> DataFrame:
    """(sg_id, into) after ``moves(sg_id, into, n)`` and merges of ``pairs(a, b, vid, n_a, n_b)``."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sg_id")).unionByName(moves.select("sg_id")).distinct()
    into = ids.join(moves.select("sg_id", "into"), "sg_id", "left").select("sg_id", F.coalesce("into", "sg_id").alias("into"))
    left, step = pairs, moves
    while True:
        for x in "ab":
            new = step.select(F.col("sg_id").alias(x), F.col("into").alias("to"), F.col("n").alias("size"))
            left = left.join(new, x, "left").withColumn(x, F.coalesce("to", x)).withColumn(f"n_{x}", F.coalesce("size", f"n_{x}")).drop("to", "size")
        low, high = F.col("a") < F.col("b"), F.col("n_a") + F.col("n_b") - 1
        left = left.where((F.col("a") != F.col("b")) & (high <= theta))
        # In the order of a hash the rounds stay few where pairs lie in a row.
        turn = F.struct(F.xxhash64("vid").alias("turn"), "vid", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        left = space.table(left.select("a", "b", "vid", "n_a", "n_b"), "left")
        if left.isEmpty():
            return into
        both = left.select(turn.alias("pair"), F.when(low, F.col("n_a")).otherwise(F.col("n_b")).alias("n_x"), F.when(low, F.col("n_b")).otherwise(F.col("n_a")).alias("n_y"))
        first = both.select(F.explode(F.array("pair.x", "pair.y")).alias("sg_id"), "pair", "n_x", "n_y").groupBy("sg_id").agg(F.min(F.struct("pair", "n_x", "n_y")).alias("p"))
        taken = first.groupBy("p").agg(F.count("*").alias("of")).where("of = 2").select("p.pair.x", "p.pair.y", (F.col("p.n_x") + F.col("p.n_y") - 1).alias("n"))
        step = space.table(taken.select(F.explode(F.array("x", "y")).alias("sg_id"), F.col("x").alias("into"), "n"), "step")
        into = into.join(step.select(F.col("sg_id").alias("into"), F.col("into").alias("to")), "into", "left").select("sg_id", F.coalesce("to", "into").alias("into"))
        into = space.table(into, "into")
