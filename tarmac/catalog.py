"""Registered queries of the road-network engine and the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import graph
from .operators import partition, queries, reports, shortcuts, whatif
from .operators.moving import MovingQueries
from .operators.skeleton import Skeleton, hub_arcs, hubs
from .plans.fixpoint import Growing, Roads, distances
from .sources.network import WIDTH, Network, ctes
from .streaming import positions

RADIUS, K, NEAR, PART, SIDE = 800, 10, 300, 10, 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL building blocks ------------------------------------------------------------------------

ARCS = "arcs AS (SELECT u AS s, v AS d, w FROM v_edges UNION ALL SELECT v, u, w FROM v_edges)"
PLACED = "seeds AS (SELECT query_id, u AS vid, offset_ AS dist FROM v_queries UNION ALL SELECT query_id, v, w - offset_ FROM v_queries)"


def _field(name: str, seeds: str, key: str, arcs: str, bound: str = "") -> str:
    """A recursive definition of least distances, by ``key`` (a column) and vertex."""
    return f"""{name}({key}, vid, dist) USING KEY ({key}, vid) AS (
      SELECT {key}, vid, min(dist) FROM {seeds} GROUP BY ALL
      UNION
      SELECT f.{key}, a.d, min(f.dist + a.w) FROM {name} f JOIN {arcs} LEFT JOIN recurring.{name} r ON r.{key} = f.{key} AND r.vid = a.d
      WHERE (r.dist IS NULL OR f.dist + a.w < r.dist) {bound} GROUP BY f.{key}, a.d)"""


def _sql(body: str, *more: str) -> str:
    return f"WITH RECURSIVE {ctes()}, {', '.join(more)}{', ' if more else ''} last AS ({body}) SELECT * FROM last"


FIELD = (ARCS, PLACED, _field("field", "seeds", "query_id", "arcs a ON f.vid = a.s"))
FOUND = """found AS (
  SELECT query_id, obj_id, min(dist) AS dist FROM (
    SELECT f.query_id, o.obj_id, f.dist + o.offset_ AS dist FROM field f JOIN v_objects o ON o.u = f.vid
    UNION ALL SELECT f.query_id, o.obj_id, f.dist + o.w - o.offset_ FROM field f JOIN v_objects o ON o.v = f.vid) GROUP BY ALL)"""
SG = (
    f"parts AS (SELECT vid, CAST(floor((vid - 1) / {PART}) AS BIGINT) AS part FROM (SELECT u AS vid FROM v_edges UNION SELECT v FROM v_edges))",
    "cut AS (SELECT vid, count(*) AS n FROM (SELECT unnest([e.u, e.v]) AS vid FROM v_edges e JOIN parts p ON p.vid = e.u JOIN parts q ON q.vid = e.v WHERE p.part <> q.part) GROUP BY vid)",
    """sg_edges AS (SELECT CASE WHEN p.part <> q.part AND cv.n < cu.n THEN q.part ELSE p.part END AS sg_id, e.u, e.v, e.w
       FROM v_edges e JOIN parts p ON p.vid = e.u JOIN parts q ON q.vid = e.v LEFT JOIN cut cu ON cu.vid = e.u LEFT JOIN cut cv ON cv.vid = e.v)""",
    "ends AS (SELECT DISTINCT sg_id, unnest([u, v]) AS vid FROM sg_edges)",
    "sg_vertices AS (SELECT sg_id, vid, count(*) OVER (PARTITION BY vid) > 1 AS is_border FROM ends)",
)
SG_DIST = (
    *SG,
    "sg_seeds AS (SELECT sg_id * 10000000 + vid AS start, vid, CAST(0 AS BIGINT) AS dist FROM ends)",
    "sg_arcs AS (SELECT sg_id, u AS s, v AS d, w FROM sg_edges UNION ALL SELECT sg_id, v, u, w FROM sg_edges)",
    _field("sg_field", "sg_seeds", "start", "sg_arcs a ON f.vid = a.s AND a.sg_id = f.start // 10000000"),
    "sg_dist AS (SELECT start // 10000000 AS sg_id, start % 10000000 AS a, vid AS b, dist AS d FROM sg_field)",
    "brd AS (SELECT sg_id, vid AS border FROM sg_vertices WHERE is_border)",
)
CLIQUE = (*SG_DIST, "clique AS (SELECT d.* FROM sg_dist d JOIN brd x ON x.sg_id = d.sg_id AND x.border = d.a JOIN brd y ON y.sg_id = d.sg_id AND y.border = d.b WHERE d.a <> d.b)")
BOUNDS = (
    *CLIQUE,
    "rbs AS (SELECT x.sg_id, x.border, 2 * max(d.d) AS rb2, count(*) AS n FROM brd x JOIN sg_dist d ON d.sg_id = x.sg_id AND d.a = x.border JOIN brd y ON y.sg_id = d.sg_id AND y.border = d.b GROUP BY ALL)",
    "ibs AS (SELECT x.sg_id, x.border, max(p.d + q.d + e.w) AS ib2, count(*) AS n FROM brd x JOIN sg_edges e ON e.sg_id = x.sg_id JOIN sg_dist p ON p.sg_id = x.sg_id AND p.a = x.border AND p.b = e.u JOIN sg_dist q ON q.sg_id = x.sg_id AND q.a = x.border AND q.b = e.v GROUP BY ALL)",
    """bounds AS (SELECT x.sg_id, x.border,
         CASE WHEN r.n = (SELECT count(*) FROM brd z WHERE z.sg_id = x.sg_id) THEN r.rb2 END AS rb2,
         CASE WHEN i.n = (SELECT count(*) FROM sg_edges z WHERE z.sg_id = x.sg_id) THEN i.ib2 END AS ib2
       FROM brd x LEFT JOIN rbs r USING (sg_id, border) LEFT JOIN ibs i USING (sg_id, border))""",
)
REWEIGHTED = """rw AS (SELECT u, v, CASE WHEN row_number() OVER (ORDER BY (u * (2654435761 + 1) + v * (40503 + 2)) % 1000003, u, v) <= CAST(round(count(*) OVER () * 0.3) AS BIGINT)
   THEN greatest(w, CAST(round(w * 1.5) AS BIGINT)) ELSE w END AS w FROM v_edges)"""
#: The same bounds after the edges took the weights of ``rw``; ownership, and so borders, stay.
_AGAIN = r"\b(sg_edges|sg_seeds|sg_arcs|sg_field|sg_dist|clique|rbs|ibs|bounds)\b"
BOUNDS_AFTER = ("sg_edges_w AS (SELECT s.sg_id, r.u, r.v, r.w FROM sg_edges s JOIN rw r ON r.u = s.u AND r.v = s.v)",
                *(re.sub(_AGAIN, r"\1_w", part) for part in BOUNDS[len(SG):] if not part.startswith("brd AS")))


def query(oracle: str | None = None):
    def register(f: Callable[[Network], DataFrame]) -> Callable[[Network], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Network(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def _sg_edges(n: Network) -> DataFrame:
    return partition.own_edges(n.edges, n.parts(PART))


def _skeleton(n: Network) -> Skeleton:
    """The skeleton's tables are read several times by a query, so they are written out."""
    return Skeleton(_sg_edges(n)).persist()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["exact_range"](spark, sf_dir)


# --- queries ------------------------------------------------------------------------------------


@query(_sql(f"SELECT query_id, obj_id, dist FROM found WHERE dist <= {RADIUS}", *FIELD, FOUND))
def exact_range(n: Network) -> DataFrame:
    return queries.exact_range(n.queries(RADIUS), n.objects, n.edges)


@query(ORACLE_SQL["exact_range"])
def exact_range_fixpoint(n: Network) -> DataFrame:
    return queries.exact_range(n.queries(RADIUS), n.objects, n.edges, method="fixpoint")


@query(_sql(f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, obj_id) AS rnk, obj_id, dist FROM found QUALIFY rnk <= {K}", *FIELD, FOUND))
def exact_knn(n: Network) -> DataFrame:
    return queries.exact_knn(n.queries(k=K), n.objects, n.edges)


DIRECT_QUERIES = "v_direct AS (SELECT obj_id AS query_id, u, v, w, CAST(w - 1 AS BIGINT) AS offset_ FROM v_objects)"
DIRECT_FIELD = (ARCS, DIRECT_QUERIES, PLACED.replace("v_queries", "v_direct"), _field("field", "seeds", "query_id", "arcs a ON f.vid = a.s", f"AND f.dist + a.w <= {NEAR}"), FOUND)


@query(
    _sql(
        f"""SELECT query_id, obj_id, min(dist) AS dist FROM (SELECT * FROM found UNION ALL
        SELECT q.query_id, o.obj_id, abs(o.offset_ - q.offset_) FROM v_direct q JOIN v_objects o ON o.u = q.u AND o.v = q.v) WHERE dist <= {NEAR} GROUP BY ALL""",
        *DIRECT_FIELD,
    )
)
def range_direct(n: Network) -> DataFrame:
    """A query at every object, with the way along a shared edge."""
    q = n.objects.select(F.col("obj_id").alias("query_id"), "u", "v", "w", (F.col("w") - 1).alias("offset_"), F.lit(NEAR).cast("bigint").alias("radius"))
    return queries.exact_range(q, n.objects, n.edges, same_edge="direct")


@query(
    _sql(
        f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, obj_id) AS rnk, obj_id, dist FROM found QUALIFY rnk <= {K}",
        ARCS, "seeds AS (SELECT query_id, u AS vid, CAST(0 AS BIGINT) AS dist FROM v_queries)", _field("field", "seeds", "query_id", "arcs a ON f.vid = a.s"), FOUND,
    )
)
def vertex_knn(n: Network) -> DataFrame:
    return queries.exact_knn(n.queries(k=K).withColumn("vid", F.col("u")), n.objects, n.edges, at_vertex=True)


@query(_sql("SELECT * FROM field", ARCS, PLACED, _field("field", "seeds", "query_id", "arcs a ON f.vid = a.s", f"AND f.dist + a.w <= {RADIUS}")))
def multi_source_field(n: Network) -> DataFrame:
    return distances(queries.seeds(n.queries(RADIUS)), graph.arcs(n.edges))


RESUMED = _sql(f"SELECT query_id, vid, dist, CASE WHEN dist <= 200 THEN 200 WHEN dist <= 400 THEN 400 ELSE {RADIUS} END AS settled_at FROM field", ARCS, PLACED, _field("field", "seeds", "query_id", "arcs a ON f.vid = a.s", f"AND f.dist + a.w <= {RADIUS}"))


def _resumed(n: Network, method: str) -> DataFrame:
    q = n.queries()
    grown, out = Growing(queries.seeds(q), Roads(graph.arcs(n.edges), method), n.space), None
    for radius in (200, 400, RADIUS):
        rows = grown.grow(q.select("query_id", F.lit(radius).alias("radius"))).withColumn("settled_at", F.lit(radius))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(RESUMED)
def resumed_field(n: Network) -> DataFrame:
    """Fields that go on from where a smaller radius ended: each vertex is settled once."""
    return _resumed(n, "local")


@query(RESUMED)
def resumed_fixpoint(n: Network) -> DataFrame:
    return _resumed(n, "fixpoint")


@query(ORACLE_SQL["multi_source_field"])
def bounded_fixpoint(n: Network) -> DataFrame:
    return distances(queries.seeds(n.queries(RADIUS)), graph.arcs(n.edges), "fixpoint")


@query(_sql("SELECT * FROM field", ARCS, "seeds AS (SELECT CAST(0 AS BIGINT) AS query_id, CAST(1 AS BIGINT) AS vid, CAST(0 AS BIGINT) AS dist)", _field("field", "seeds", "query_id", "arcs a ON f.vid = a.s")))
def single_source_distances(n: Network) -> DataFrame:
    one = n.spark.createDataFrame([(0, 1)], "query_id long, vid long")
    return distances(queries.vertex_seeds(one), graph.arcs(n.edges))


@query(
    _sql(
        f"""SELECT query_id, r.radius, count(DISTINCT f.vid) AS reached,
          (SELECT count(*) FROM field g JOIN arcs a ON a.s = g.vid WHERE g.query_id = f.query_id AND g.dist <= r.radius AND g.dist + a.w > r.radius) AS outward_arcs,
          (SELECT count(DISTINCT g.vid) FROM field g JOIN arcs a ON a.s = g.vid WHERE g.query_id = f.query_id AND g.dist <= r.radius AND g.dist + a.w > r.radius) AS frontier_vertices
        FROM field f CROSS JOIN (VALUES (CAST(200 AS BIGINT)), (400), ({RADIUS})) r(radius) WHERE f.dist <= r.radius GROUP BY f.query_id, r.radius""",
        *FIELD,
    )
)
def frontier_stats(n: Network) -> DataFrame:
    return queries.frontier(n.queries(), n.edges, [200, 400, RADIUS])


MOVED = "v_moved AS (SELECT query_id, u, v, w, CASE WHEN query_id % 2 = 0 THEN CAST(0 AS BIGINT) ELSE offset_ END AS offset_ FROM v_queries)"


@query(_sql(f"SELECT query_id, obj_id, dist FROM found WHERE dist <= {RADIUS}", ARCS, MOVED, PLACED.replace("v_queries", "v_moved"), FIELD[2], FOUND))
def continuous_range(n: Network) -> DataFrame:
    q = n.queries(RADIUS)
    moves = q.where("query_id % 2 = 0").select("query_id", F.lit(0).cast("bigint").alias("offset_"))
    return queries.continuous_range(q, moves, n.objects, n.edges)


# --- graph operations ---------------------------------------------------------------------------


@query(_sql("SELECT u, v, w FROM v_edges"))
def canonical_edges(n: Network) -> DataFrame:
    e = n.edges
    return graph.canonical(graph.arcs(e).select(F.col("s").alias("u"), F.col("d").alias("v"), "w").unionByName(e.withColumn("w", F.col("w") + 5)))


@query(_sql("SELECT s AS vid, count(*) AS degree, min(w) AS min_w, max(w) AS max_w FROM arcs GROUP BY s", ARCS))
def vertex_degrees(n: Network) -> DataFrame:
    return graph.degrees(n.edges)


@query(_sql("SELECT s AS vid, d AS neighbour, w FROM arcs", ARCS))
def neighbours(n: Network) -> DataFrame:
    return graph.neighbours(n.edges, graph.vertices(n.edges))


@query(_sql("SELECT u, v, CASE WHEN (u + v) % 5 = 0 THEN w + 3 ELSE w END AS w FROM v_edges"))
def connect_edges(n: Network) -> DataFrame:
    return graph.connect(n.edges, n.edges.where("(u + v) % 5 = 0").select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("w") + 3).alias("w")))


@query(_sql("SELECT u, v, CASE WHEN (u + v) % 5 = 0 AND w > 40 THEN 40 ELSE w END AS w FROM v_edges"))
def min_weight_edges(n: Network) -> DataFrame:
    return graph.connect(n.edges, n.edges.where("(u + v) % 5 = 0").withColumn("w", F.lit(40).cast("bigint")), "min")


@query(_sql("SELECT u, v, w FROM v_edges WHERE u % 3 <> 0"))
def disconnect_edges(n: Network) -> DataFrame:
    return graph.disconnect(n.edges, n.edges.where("u % 3 = 0").select("v", "u"))


@query(_sql("SELECT u, v, CASE WHEN u % 4 = 0 THEN w * 2 ELSE w END AS w FROM v_edges"))
def replace_weights(n: Network) -> DataFrame:
    return graph.replace(n.edges, n.edges.where("u % 4 = 0").withColumn("w", F.col("w") * 2))


@query(_sql("SELECT p.a, p.b, e.w IS NOT NULL AS has_edge, e.w AS weight FROM (SELECT v AS a, u AS b FROM v_edges UNION SELECT u, u + 2 FROM v_edges) p LEFT JOIN v_edges e ON e.u = least(p.a, p.b) AND e.v = greatest(p.a, p.b)"))
def edge_lookup(n: Network) -> DataFrame:
    e = n.edges
    pairs = e.select(F.col("v").alias("a"), F.col("u").alias("b")).union(e.select("u", F.col("u") + 2)).distinct()
    return graph.lookup(e, pairs)


@query(_sql("SELECT * FROM rw", REWEIGHTED))
def reweight_edges(n: Network) -> DataFrame:
    return graph.reweight(n.edges, 0.3, 1.5)


XY = f"xy AS (SELECT vid, CAST((vid - 1) % 40 AS DOUBLE) AS x, CAST(floor((vid - 1) / 40) AS DOUBLE) AS y FROM (SELECT u AS vid FROM v_edges UNION SELECT v FROM v_edges))"
POINTS = "pts AS (SELECT o.*, a.x + (b.x - a.x) * (o.offset_ / o.w) AS x, a.y + (b.y - a.y) * (o.offset_ / o.w) AS y FROM v_objects o JOIN xy a ON a.vid = o.u JOIN xy b ON b.vid = o.v)"
CELL = f"""cells AS (SELECT CAST(least({SIDE - 1}, greatest(0, floor((p.y - y0) / (y1 - y0) * {SIDE}))) * {SIDE} + least({SIDE - 1}, greatest(0, floor((p.x - x0) / (x1 - x0) * {SIDE}))) AS BIGINT) AS cell
   FROM pts p CROSS JOIN (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy))"""


@query(_sql("SELECT obj_id, round(x, 6) AS x, round(y, 6) AS y FROM pts", XY, POINTS))
def object_coordinates(n: Network) -> DataFrame:
    return graph.interpolate(n.objects, n.coords).select("obj_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(_sql("SELECT cell, count(*) AS n FROM cells GROUP BY cell", XY, POINTS, CELL))
def grid_cell_buckets(n: Network) -> DataFrame:
    return positions.cell_buckets(n.objects, n.coords, SIDE)


@query(_sql("SELECT obj_id, u, v, w, offset_ FROM v_objects"))
def objects_on_edges(n: Network) -> DataFrame:
    return queries.objects_on(n.objects, n.edges.select("v", "u")).select("obj_id", "u", "v", "w", "offset_")


@query(_sql("SELECT u AS vid, obj_id FROM v_objects UNION ALL SELECT v, obj_id FROM v_objects"))
def objects_at_vertices(n: Network) -> DataFrame:
    return queries.objects_at(n.objects, graph.vertices(n.edges))


# --- partition ----------------------------------------------------------------------------------


@query(_sql("SELECT sg_id, u, v, w FROM sg_edges", *SG))
def own_edges(n: Network) -> DataFrame:
    return _sg_edges(n)


@query(_sql("SELECT * FROM sg_vertices", *SG))
def border_vertices(n: Network) -> DataFrame:
    return partition.sg_vertices(_sg_edges(n))


@query(_sql("SELECT sg_id, a, b, d FROM sg_dist", *SG_DIST))
def subgraph_distances(n: Network) -> DataFrame:
    return partition.all_pairs(_sg_edges(n))


@query(_sql("SELECT *, coalesce(rb2 >= ib2, false) AS br_ok FROM bounds", *BOUNDS))
def border_bounds(n: Network) -> DataFrame:
    return _skeleton(n).bounds()


@query(_sql("SELECT d.sg_id, d.b AS vid, min(d.d) AS md FROM sg_dist d JOIN brd x ON x.sg_id = d.sg_id AND x.border = d.a GROUP BY ALL", *SG_DIST))
def nearest_borders(n: Network) -> DataFrame:
    e = _sg_edges(n)
    return partition.nearest_border(partition.all_pairs(e), partition.sg_vertices(e))


@query(_sql("SELECT sg_id, count(*) AS objects FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v GROUP BY sg_id", *SG))
def objects_in_subgraphs(n: Network) -> DataFrame:
    return queries.objects_in(n.objects, _sg_edges(n)).groupBy("sg_id").agg(F.count("*").alias("objects"))


@query(_sql("SELECT count(*) AS occupied, CAST(sum(n) AS BIGINT) AS objects, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT sg_id, count(*) AS n FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v GROUP BY sg_id)", *SG))
def occupancy_stats(n: Network) -> DataFrame:
    return queries.occupancy(n.objects, _sg_edges(n))


@query(_sql("SELECT n // 10 * 10 AS bucket, count(*) AS n FROM (SELECT sg_id, count(*) AS n FROM ends GROUP BY sg_id) GROUP BY 1", *SG))
def partition_histogram(n: Network) -> DataFrame:
    return reports.size_histogram(_sg_edges(n))


@query(
    _sql(
        """SELECT (SELECT count(*) FROM v_edges) AS graph_edges, CAST(0 AS BIGINT) AS missing_edges, CAST(0 AS BIGINT) AS ghost_edges, CAST(0 AS BIGINT) AS shared_edges,
          (SELECT count(DISTINCT sg_id) FROM ends) AS subgraphs, (SELECT max(n) FROM (SELECT count(*) AS n FROM ends GROUP BY sg_id)) AS max_vertices,
          (SELECT count(*) FROM brd) AS border_slots, (SELECT count(*) FROM sg_vertices WHERE NOT is_border) AS internal_vertices,
          (SELECT count(*) FROM bounds WHERE NOT coalesce(rb2 >= ib2, false)) AS br_broken, (SELECT count(DISTINCT border) FROM brd) AS borders""",
        *BOUNDS,
    )
)
def partition_audit(n: Network) -> DataFrame:
    return reports.partition_audit(n.edges, _sg_edges(n))


BROKEN = "count(*) AS borders, count(*) FILTER (NOT coalesce(rb2 >= ib2, false)) AS br_broken"


@query(_sql(f"SELECT 'before' AS state, {BROKEN} FROM bounds UNION ALL SELECT 'after', {BROKEN} FROM bounds_w", *BOUNDS, REWEIGHTED, *BOUNDS_AFTER))
def weight_audit(n: Network) -> DataFrame:
    return reports.weight_audit(n.edges, graph.reweight(n.edges, 0.3, 1.5), _sg_edges(n))


@query()
def grown_partition(n: Network) -> DataFrame:
    return partition.grow_parts(n.edges, 8)


@query()
def merged_partition(n: Network) -> DataFrame:
    return partition.merge_small(partition.grow_parts(n.edges, 8), 16)


# --- skeleton -----------------------------------------------------------------------------------


@query(_sql("SELECT sg_id, a, b, d FROM clique", *CLIQUE))
def border_clique(n: Network) -> DataFrame:
    return _skeleton(n).clique()


@query(_sql("SELECT a, b, min(d) AS w FROM clique WHERE a < b GROUP BY a, b", *CLIQUE))
def skeleton_graph(n: Network) -> DataFrame:
    return _skeleton(n).skeleton()


@query(_sql("SELECT x.sg_id AS sg_a, y.sg_id AS sg_b, count(*) AS shared FROM brd x JOIN brd y ON x.border = y.border AND x.sg_id < y.sg_id GROUP BY ALL", *SG_DIST))
def subgraph_adjacency(n: Network) -> DataFrame:
    return _skeleton(n).sg_adjacency()


@query(
    _sql(
        """SELECT o.obj_id, e.sg_id, x.border, min(CASE WHEN d.b = o.u THEN d.d + o.offset_ ELSE d.d + o.w - o.offset_ END) AS cost
        FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v JOIN brd x ON x.sg_id = e.sg_id JOIN sg_dist d ON d.sg_id = e.sg_id AND d.a = x.border AND d.b IN (o.u, o.v) GROUP BY ALL""",
        *SG_DIST,
    )
)
def object_border_costs(n: Network) -> DataFrame:
    return _skeleton(n).border_costs(n.objects)


@query(_sql(f"SELECT query_id, obj_id FROM found WHERE dist <= {RADIUS}", *FIELD, FOUND))
def skeleton_range(n: Network) -> DataFrame:
    return _skeleton(n).range(n.queries(RADIUS), n.objects)


@query(ORACLE_SQL["exact_knn"])
def skeleton_knn(n: Network) -> DataFrame:
    return _skeleton(n).knn(n.queries(k=K), n.objects, 400)


@query(ORACLE_SQL["exact_knn"])
def threshold_knn(n: Network) -> DataFrame:
    return _skeleton(n).threshold_knn(n.queries(k=K), n.objects, 400)


@query(
    _sql(
        f"""SELECT r.query_id, r.sg_id, min(r.d) AS lb, coalesce(min(2 * r.d + b.ib2) <= {2 * RADIUS}, false) AS ib, coalesce(min(2 * r.d + b.rb2) <= {2 * RADIUS}, false) AS ub,
          coalesce(min(2 * r.d + b.rb2) <= {2 * RADIUS}, false) AND count(*) = max(n.n) AS paper, count(*) = max(n.n) AS all_borders
        FROM (SELECT f.query_id, x.sg_id, x.border, f.dist AS d FROM field f JOIN brd x ON x.border = f.vid WHERE f.dist <= {RADIUS}) r
        JOIN bounds b ON b.sg_id = r.sg_id AND b.border = r.border JOIN (SELECT sg_id, count(*) AS n FROM brd GROUP BY sg_id) n ON n.sg_id = r.sg_id GROUP BY r.query_id, r.sg_id""",
        *BOUNDS, *FIELD,
    )
)
def cover_rules(n: Network) -> DataFrame:
    s = _skeleton(n)
    q = n.queries(RADIUS)
    return s.classify(q, s.border_distances(q))


def _variant(parts: tuple[str, ...], names: str, suffix: str, *changes: tuple[str, str]) -> tuple[str, ...]:
    """The same definitions under other names, with some text changed."""
    out = []
    for part in parts:
        for old, new in changes:
            part = part.replace(old, new)
        out.append(re.sub(rf"\b({names})\b", rf"\1{suffix}", part))
    return tuple(out)


#: The partition into runs three times as long.
LONG = 3 * PART
SG_COLUMNS = _variant(SG, "parts|cut|sg_edges|ends|sg_vertices", "_columns", (f"CAST(floor((vid - 1) / {PART}) AS BIGINT)", f"(vid - 1) % {WIDTH}"))
SG_LONG = _variant(SG, "parts|cut|sg_edges|ends|sg_vertices", "_long", (f"/ {PART})", f"/ {LONG})"))


ADMIT_K = 40


@query(
    _sql(
        f"""SELECT s.query_id, s.sg_id, p.obj_id FROM spans s JOIN placed_ p ON p.sg_id = s.sg_id
        WHERE s.high2 <= {2 * RADIUS} AND (SELECT sum(t.n) FROM spans t WHERE t.query_id = s.query_id AND t.low2 <= s.high2) <= {ADMIT_K}""",
        *BOUNDS, *FIELD, "placed_ AS (SELECT o.obj_id, e.sg_id FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v)",
        f"""spans AS (SELECT m.query_id, m.sg_id, min(m.low2) AS low2, min(m.high2) AS high2, max(w.n) AS n FROM (
          SELECT f.query_id, b.sg_id, 2 * f.dist AS low2, 2 * f.dist + b.ib2 AS high2 FROM field f JOIN bounds b ON b.border = f.vid WHERE f.dist <= {RADIUS}
          UNION ALL SELECT q.query_id, e.sg_id, 0, NULL FROM v_queries q JOIN sg_edges e ON e.u = q.u AND e.v = q.v) m
        JOIN (SELECT sg_id, count(*) AS n FROM placed_ GROUP BY sg_id) w ON w.sg_id = m.sg_id GROUP BY ALL)""",
    )
)
def knn_admission(n: Network) -> DataFrame:
    """Objects that bounds of their subgraphs alone show to be among the nearest."""
    return _skeleton(n).admitted(n.queries(RADIUS, ADMIT_K), n.objects)


DEMOTED = 8


@query(
    _sql(
        f"""SELECT c.sg_id, c.border, count(b.obj_id) AS results, count(b.obj_id) FILTER (s.dist IS NULL) AS lost, count(b.obj_id) FILTER (s.dist > b.dist) AS farther,
          count(b.obj_id) FILTER (s.dist IS NULL OR s.dist > b.dist) = 0 AS exact
        FROM scen c LEFT JOIN (SELECT * FROM found WHERE dist <= {RADIUS}) b ON true
        LEFT JOIN (SELECT id, query_id, obj_id, min(dist) AS dist FROM scored GROUP BY ALL HAVING min(dist) <= {RADIUS}) s ON s.id = c.id AND s.query_id = b.query_id AND s.obj_id = b.obj_id
        GROUP BY c.id, c.sg_id, c.border""",
        *CLIQUE, *FIELD, FOUND,
        f"""scen AS (SELECT row_number() OVER (ORDER BY touches DESC, sg_id, border) AS id, sg_id, border FROM (
          SELECT x.sg_id, x.border, count(*) AS touches FROM field f JOIN brd x ON x.border = f.vid WHERE f.dist <= {RADIUS} GROUP BY ALL) ORDER BY touches DESC, sg_id, border LIMIT {DEMOTED})""",
        """own_ AS (SELECT q.query_id, e.sg_id, d.b AS vid, min(d.d + CASE WHEN d.a = q.u THEN q.offset_ ELSE q.w - q.offset_ END) AS dist
          FROM v_queries q JOIN sg_edges e ON e.u = q.u AND e.v = q.v JOIN sg_dist d ON d.sg_id = e.sg_id AND d.a IN (q.u, q.v) GROUP BY ALL)""",
        "first_ AS (SELECT c.id * 1000 + o.query_id AS k, o.vid, o.dist FROM own_ o JOIN brd x ON x.sg_id = o.sg_id AND x.border = o.vid JOIN scen c ON NOT (o.sg_id = c.sg_id AND o.vid = c.border))",
        _field("tried", "first_", "k", "scen c ON c.id = f.k // 1000 JOIN (SELECT sg_id, a AS s, b AS d, d AS w FROM clique) a ON f.vid = a.s AND NOT (a.sg_id = c.sg_id AND (a.s = c.border OR a.d = c.border))", f"AND f.dist + a.w <= {RADIUS}"),
        f"""placed_ AS (SELECT o.*, e.sg_id FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v),
        scored AS (
          SELECT c.id, t.k % 1000 AS query_id, o.obj_id, t.dist + d.d + CASE WHEN d.b = o.u THEN o.offset_ ELSE o.w - o.offset_ END AS dist FROM tried t JOIN scen c ON c.id = t.k // 1000
          JOIN brd x ON x.border = t.vid AND NOT (x.sg_id = c.sg_id AND x.border = c.border) JOIN placed_ o ON o.sg_id = x.sg_id JOIN sg_dist d ON d.sg_id = x.sg_id AND d.a = x.border AND d.b IN (o.u, o.v) WHERE t.dist <= {RADIUS}
          UNION ALL SELECT c.id, w.query_id, o.obj_id, w.dist + CASE WHEN w.vid = o.u THEN o.offset_ ELSE o.w - o.offset_ END FROM own_ w JOIN placed_ o ON o.sg_id = w.sg_id AND w.vid IN (o.u, o.v) CROSS JOIN scen c)""",
    )
)
def demotion_verdicts(n: Network) -> DataFrame:
    """What the results of a batch would be without each of the borders that most queries reach (a top list)."""
    s, q = _skeleton(n), n.queries(RADIUS)
    return whatif.demotion_verdicts(s, q, n.objects, whatif.most_touched(s, q, DEMOTED))


@query(_sql(f"SELECT f.query_id, f.vid AS border, f.dist AS d FROM field f WHERE f.dist <= {RADIUS} AND f.vid IN (SELECT vid FROM sg_vertices_long WHERE is_border)", *SG_LONG, *FIELD))
def hub_search(n: Network) -> DataFrame:
    """Distances of borders by a search through hubs."""
    s = Skeleton(partition.own_edges(n.edges, n.parts(LONG))).persist()
    to, _ = hubs(s, least_borders=6, ratio=1.0)
    return s.border_distances(n.queries(RADIUS), arcs=hub_arcs(s, n.space.table(to, "ways")))


STEPS, PER = 3, 2
SHORTCUTS = (
    *CLIQUE, ARCS,
    """reps AS (SELECT n.sg_id, coalesce(r.a, n.first) AS rep FROM (SELECT sg_id, count(*) AS n, min(border) AS first FROM brd GROUP BY sg_id) n LEFT JOIN (
      SELECT sg_id, a FROM (SELECT c.sg_id, c.a, sum(c.d) AS total, count(*) AS reached FROM clique c GROUP BY ALL) s
      WHERE reached = (SELECT count(*) - 1 FROM brd x WHERE x.sg_id = s.sg_id) QUALIFY row_number() OVER (PARTITION BY sg_id ORDER BY total, a) = 1) r ON r.sg_id = n.sg_id)""",
    "next_ AS (SELECT DISTINCT x.sg_id, y.sg_id AS other FROM brd x JOIN brd y ON x.border = y.border AND x.sg_id <> y.sg_id)",
    f"steps(sg_id, other, n) AS (SELECT sg_id, sg_id, 0 FROM (SELECT DISTINCT sg_id FROM next_) UNION SELECT s.sg_id, x.other, s.n + 1 FROM steps s JOIN next_ x ON x.sg_id = s.other WHERE s.n < {STEPS})",
    "rep_seeds AS (SELECT sg_id, rep AS vid, CAST(0 AS BIGINT) AS dist FROM reps)",
    _field("rep_field", "rep_seeds", "sg_id", "arcs a ON f.vid = a.s"),
    f"""cuts AS (SELECT p.sg_id AS sg_a, p.other AS sg_b, x.rep AS a, y.rep AS b, f.dist AS w FROM (SELECT sg_id, other FROM steps GROUP BY ALL HAVING min(n) = {STEPS}) p
      JOIN reps x ON x.sg_id = p.sg_id JOIN reps y ON y.sg_id = p.other JOIN rep_field f ON f.sg_id = p.sg_id AND f.vid = y.rep WHERE x.rep <> y.rep
      QUALIFY row_number() OVER (PARTITION BY p.sg_id ORDER BY f.dist, p.other) <= {PER})""",
)


@query(_sql("SELECT sg_a, sg_b, a, b, w FROM cuts", *SHORTCUTS))
def shortcut_arcs(n: Network) -> DataFrame:
    return shortcuts.shortcuts(_skeleton(n), STEPS, PER)


@query(_sql(f"SELECT f.query_id, f.vid AS border, f.dist AS d FROM field f WHERE f.dist <= {RADIUS} AND f.vid IN (SELECT border FROM brd)", *SG_DIST, *FIELD))
def shortcut_search(n: Network) -> DataFrame:
    """Distances of borders over the skeleton with shortcuts: the same as without."""
    s = _skeleton(n)
    return s.border_distances(n.queries(RADIUS), arcs=shortcuts.with_shortcuts(s.roads().arcs, shortcuts.shortcuts(s, STEPS, PER)))


COVERAGE = (*SG, *FIELD, FOUND, f"""cov AS (SELECT f.query_id, e.sg_id, count(*) AS n, max(t.n) AS total FROM found f JOIN v_objects o USING (obj_id) JOIN sg_edges e ON e.u = o.u AND e.v = o.v
   JOIN (SELECT sg_id, count(*) AS n FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v GROUP BY sg_id) t ON t.sg_id = e.sg_id WHERE f.dist <= {RADIUS} GROUP BY ALL)""")


@query(_sql("SELECT query_id, count(*) AS touched, count(*) FILTER (n = total) AS \"full\", CAST(sum(n) AS BIGINT) AS result_objects, CAST(coalesce(sum(n) FILTER (n = total), 0) AS BIGINT) AS full_objects FROM cov GROUP BY query_id", *COVERAGE))
def coverage_report(n: Network) -> DataFrame:
    return reports.coverage(queries.exact_range(n.queries(RADIUS), n.objects, n.edges), n.objects, _sg_edges(n))


@query(
    _sql(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS method, CAST(sum(touched) AS BIGINT) AS touched, CAST(sum(f) AS BIGINT) AS "full", CAST(sum(ro) AS BIGINT) AS result_objects, CAST(sum(fo) AS BIGINT) AS full_objects, round(sum(fo) / sum(ro), 6) AS object_ratio FROM (
            SELECT query_id, count(*) AS touched, count(*) FILTER (n = total) AS f, sum(n) AS ro, coalesce(sum(n) FILTER (n = total), 0) AS fo FROM {table} GROUP BY query_id)"""
            for name, table in (("rows", "cov"), ("long rows", "cov_long"), ("columns", "cov_columns"))
        ),
        *COVERAGE, *SG_LONG, *SG_COLUMNS, *_variant(COVERAGE[-1:], "cov|sg_edges", "_long"), *_variant(COVERAGE[-1:], "cov|sg_edges", "_columns"),
    )
)
def coverage_compare(n: Network) -> DataFrame:
    """Three partitions: short and long runs along rows of the network, and columns of it."""
    found = n.space.table(queries.exact_range(n.queries(RADIUS), n.objects, n.edges), "found")
    columns = graph.vertices(n.edges).select("vid", ((F.col("vid") - 1) % WIDTH).alias("part"))
    owned = {"rows": _sg_edges(n), "long rows": partition.own_edges(n.edges, n.parts(LONG)), "columns": partition.own_edges(n.edges, columns)}
    return reports.coverage_compare(found, n.objects, {name: n.space.table(df, "owned") for name, df in owned.items()})


@query(
    _sql(
        """SELECT s.sg_id, s.vid AS border, t.subgraphs, i.n AS inside_degree, t.n - i.n AS external_degree FROM sg_vertices s
        JOIN (SELECT sg_id, vid, count(*) AS n FROM (SELECT sg_id, unnest([u, v]) AS vid FROM sg_edges) GROUP BY ALL) i ON i.sg_id = s.sg_id AND i.vid = s.vid
        JOIN (SELECT vid, count(*) AS n, count(DISTINCT sg_id) AS subgraphs FROM (SELECT sg_id, unnest([u, v]) AS vid FROM sg_edges) GROUP BY vid) t ON t.vid = s.vid WHERE s.is_border""",
        *SG,
    )
)
def border_topology(n: Network) -> DataFrame:
    return reports.border_topology(_sg_edges(n))


@query(_sql("SELECT sg_id, a AS border, min(d) AS nearest FROM clique GROUP BY ALL", *CLIQUE))
def nearest_other_border(n: Network) -> DataFrame:
    return reports.nearest_other_border(_skeleton(n))


@query(
    _sql(
        """SELECT b.sg_id, b.border, b.rb2 - b.ib2 AS slack2, coalesce(m.n, 0) AS witnesses FROM bounds b LEFT JOIN (
        SELECT sg_id, a, count(*) AS n FROM (SELECT *, max(d) OVER (PARTITION BY sg_id, a) AS top FROM clique) WHERE d = top GROUP BY ALL) m ON m.sg_id = b.sg_id AND m.a = b.border""",
        *BOUNDS,
    )
)
def border_slack(n: Network) -> DataFrame:
    return reports.border_slack(_skeleton(n))


REACHED = f"reached AS (SELECT f.query_id, f.vid AS border, f.dist AS d FROM field f WHERE f.dist <= {RADIUS} AND f.vid IN (SELECT border FROM brd))"


@query(
    _sql(
        """SELECT r.border, count(*) AS touches, min(rank) AS first_rank, count(*) * max(n.n) AS pairs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, border) AS rank FROM reached) r
        JOIN (SELECT border, count(*) AS n FROM brd GROUP BY border) n ON n.border = r.border GROUP BY r.border""",
        *SG_DIST, *FIELD, REACHED,
    )
)
def border_exposure(n: Network) -> DataFrame:
    s = _skeleton(n)
    return reports.exposure(s.border_distances(n.queries(RADIUS)), s.border_sg)


@query(_sql("SELECT sg_id, count(*) AS events, round(count(*) / (SELECT count(*) FROM reached r JOIN brd USING (border)), 6) AS share FROM reached JOIN brd USING (border) GROUP BY sg_id", *SG_DIST, *FIELD, REACHED))
def skeleton_hotspots(n: Network) -> DataFrame:
    s = _skeleton(n)
    return reports.hotspots(s.border_distances(n.queries(RADIUS)), s.border_sg)


RADII = f"radii AS (SELECT CAST(r AS BIGINT) AS radius FROM (VALUES (200), (400), ({RADIUS})) AS t(r))"


@query(
    _sql(
        """SELECT c.radius, count(*) AS touched, count(*) FILTER (c.ib) AS ib, count(*) FILTER (c.ub) AS ub, count(*) FILTER (c.ub AND c.every) AS paper, count(*) FILTER (c.every) AS all_borders, max(c.results) AS results FROM (
          SELECT r.radius, r.query_id, r.sg_id, coalesce(min(2 * r.d + b.ib2) <= 2 * r.radius, false) AS ib, coalesce(min(2 * r.d + b.rb2) <= 2 * r.radius, false) AS ub, count(*) = max(n.n) AS every,
            (SELECT count(*) FROM found o WHERE o.dist <= r.radius) AS results
          FROM (SELECT f.query_id, v.radius, x.sg_id, x.border, f.dist AS d FROM field f JOIN brd x ON x.border = f.vid JOIN radii v ON f.dist <= v.radius) r
          JOIN bounds b ON b.sg_id = r.sg_id AND b.border = r.border JOIN (SELECT sg_id, count(*) AS n FROM brd GROUP BY sg_id) n ON n.sg_id = r.sg_id GROUP BY r.radius, r.query_id, r.sg_id) c GROUP BY c.radius""",
        *BOUNDS, *FIELD, FOUND, RADII,
    )
)
def query_sweep(n: Network) -> DataFrame:
    return reports.sweep(_skeleton(n), n.queries(RADIUS), n.objects, [200, 400, RADIUS])


@query(_sql("SELECT structure, n, n * width AS bytes FROM (SELECT 'edges' AS structure, count(*) AS n, 24 AS width FROM v_edges UNION ALL SELECT 'objects', count(*), 40 FROM v_objects UNION ALL SELECT 'skeleton', count(*), 24 FROM (SELECT DISTINCT a, b FROM clique WHERE a < b))", *CLIQUE))
def memory_report(n: Network) -> DataFrame:
    return reports.memory_report({"edges": (n.edges, 24), "objects": (n.objects, 40), "skeleton": (_skeleton(n).skeleton(), 24)})


# --- updates ------------------------------------------------------------------------------------


@query(_sql("SELECT * FROM v_objects"))
def latest_positions(n: Network) -> DataFrame:
    return positions.latest(n.positions)


@query(_sql(f"SELECT q.query_id, count(f.obj_id) AS result_count FROM v_queries q LEFT JOIN (SELECT * FROM found WHERE dist <= {RADIUS}) f ON f.query_id = q.query_id GROUP BY q.query_id", *FIELD, FOUND))
def standing_counts(n: Network) -> DataFrame:
    q = n.queries(RADIUS)
    return positions.counts(positions.standing_fields(q, n.edges), n.objects, q)


@query(ORACLE_SQL["standing_counts"].replace("result_count", "delta"))
def standing_deltas(n: Network) -> DataFrame:
    """The sum of all membership changes from the first update on is the final count."""
    q = n.queries(RADIUS)
    return positions.deltas_by_query(positions.standing_fields(q, n.edges), positions.transitions(n.positions), q)


@query(ORACLE_SQL["standing_counts"].replace("result_count", "delta"))
def indexed_deltas(n: Network) -> DataFrame:
    q = n.queries(RADIUS)
    index = positions.edge_index(positions.standing_fields(q, n.edges), n.edges, q)
    return positions.deltas_by_edge(index, positions.transitions(n.positions), q)


@query(
    _sql(
        """SELECT 'edge' AS kind, u AS key_u, v AS key_v, count(*) AS n FROM v_objects GROUP BY u, v
        UNION ALL SELECT 'left', u, NULL, count(*) FROM v_objects GROUP BY u UNION ALL SELECT 'right', v, NULL, count(*) FROM v_objects GROUP BY v"""
    )
)
def anchor_buckets(n: Network) -> DataFrame:
    return positions.anchor_buckets(n.objects)


TO_ZERO = "v_moved AS (SELECT query_id, u, v, w, CASE WHEN query_id % 2 = 0 THEN CAST(0 AS BIGINT) ELSE w - 1 END AS offset_ FROM v_queries)"
MOVED_FIELD = (ARCS, TO_ZERO, PLACED.replace("v_queries", "v_moved"), _field("field", "seeds", "query_id", "arcs a ON f.vid = a.s", f"AND f.dist + a.w <= {RADIUS}"))


def _moved(n: Network) -> MovingQueries:
    """Queries after two moves: all to the middle of their edges, then each to one end or next to the other."""
    q = n.queries(RADIUS)
    moving = MovingQueries(q, n.space.table(graph.arcs(n.edges), "arcs"))
    moving.move(q.select("query_id", F.expr("w div 2").alias("offset_")))
    moving.move(q.select("query_id", F.when(F.col("query_id") % 2 == 0, 0).otherwise(F.col("w") - 1).alias("offset_")))
    return moving


@query(_sql(f"SELECT query_id, vid, dist FROM field WHERE dist <= {RADIUS}", *MOVED_FIELD))
def moved_query_fields(n: Network) -> DataFrame:
    """Fields of queries that moved twice, shifted and searched again only where they may change."""
    return _moved(n).field.select("query_id", "vid", "dist")


@query(_sql(f"SELECT query_id, obj_id, dist FROM found WHERE dist <= {RADIUS}", *MOVED_FIELD, FOUND))
def moved_query_results(n: Network) -> DataFrame:
    return _moved(n).results(n.objects)


@query(ORACLE_SQL["standing_counts"])
def streamed_counts(n: Network) -> DataFrame:
    """Counts of standing queries kept by a stream that has late rows, and a seventh of all rows twice."""
    q = n.queries(RADIUS)
    index = n.space.table(positions.edge_index(positions.standing_fields(q, n.edges), n.edges, q), "index")
    rows = n.positions.unionByName(n.positions.where("event_id % 7 = 0")).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "obj_id", "u", "v", "w", "offset_")
    third = -(-int(n.spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    rows.repartition(3 * third, "event_id").write.parquet(log := n.space.path("log"))
    job = positions.StandingCounts(n.spark, n.space.path("standing"), index, q)
    job.run(n.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", third).parquet(log))
    return job.counts()


@query()
def relocated_objects(n: Network) -> DataFrame:
    return positions.relocate(n.objects, n.edges, 3)


@query()
def locally_moved_objects(n: Network) -> DataFrame:
    return positions.move_locally(n.objects, n.edges, 3)


@query(_sql("SELECT count(*) AS edges, min(w) AS min_w, max(w) AS max_w, round(avg(w), 6) AS mean_w, count(DISTINCT w) AS distinct_w FROM v_edges"))
def edge_lengths(n: Network) -> DataFrame:
    return reports.edge_length_report(n.edges)
