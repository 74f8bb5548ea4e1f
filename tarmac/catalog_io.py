"""Registered queries of files, caches, generators, epochs of updates and partition commands, with the SQL they are checked against.

Files are written to the shared folder and read back by the package's readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ARCS, CLIQUE, FIELD, FOUND, K, LONG, PART, RADIUS, SG, SG_DIST, XY, _field, _sg_edges, _skeleton, _sql, _variant, query
from .catalog import ORACLE_SQL as ORACLE_SQL
from .catalog import QUERIES as REGISTERED
from .functions import graph
from .operators import partition, queries, reports
from .operators.skeleton import Skeleton, group_subgraphs, hubs
from .plans.fixpoint import distances, origins, to_targets
from .sources import files, generators
from .sources.network import Network
from .streaming import positions
from .streaming.derived import DerivedRows

EPOCHS, OBJECTS, THETA = 4, 500, 8

# --- files and caches -----------------------------------------------------------------------------


@query(_sql("SELECT u, v, w FROM v_edges"))
def dimacs_graph(n: Network) -> DataFrame:
    files.write_graph(n.edges, path := n.space.path("graph"))
    return files.read_graph(n.spark, path)


@query(_sql("SELECT s AS u, d AS v, w FROM arcs", ARCS))
def dimacs_arcs_lenient(n: Network) -> DataFrame:
    """Lines that are none of the format are dropped; both directions stay."""
    arcs = graph.arcs(n.edges).select(F.concat_ws(" ", F.lit("a"), "s", "d", "w").alias("value"))
    junk = n.edges.select(F.explode(F.array(F.concat_ws(" ", F.lit("x"), "u", "v"), F.concat(F.lit("c edge "), "u"), F.lit(""))).alias("value"))
    arcs.unionByName(junk).write.text(path := n.space.path("lenient"))
    return files.read_arcs(n.spark, path, strict=False)


@query(_sql("SELECT * FROM xy", XY))
def coordinates_file(n: Network) -> DataFrame:
    lines = n.coords.select(F.explode(F.array(F.concat_ws(" ", F.lit("v"), "vid", "x", "y"), F.concat(F.lit("c "), F.col("vid").cast("string")))).alias("value"))
    lines.write.text(path := n.space.path("coordinates"))
    return files.read_coordinates(n.spark, path)


@query(_sql("SELECT * FROM parts", *SG))
def assignment_file(n: Network) -> DataFrame:
    n.parts(PART).select(F.col("vid").alias("vertex_id"), "part").write.option("header", True).csv(path := n.space.path("assignment"))
    return files.read_assignment(n.spark, path)


@query(_sql("SELECT row_number() OVER (ORDER BY obj_id) - 1 AS obj_id, u, v, offset_ FROM v_objects"))
def objects_file(n: Network) -> DataFrame:
    """Ids follow the order of the lines."""
    files.write_objects(n.objects, path := n.space.path("objects"))
    return files.read_objects(n.spark, path)


@query(_sql("SELECT obj_id, u, v, w, offset_ FROM v_objects"))
def objects_table(n: Network) -> DataFrame:
    """Loaded if it is there, else made and saved."""
    cache = files.TableCache(n.spark, n.space.path("cache"))
    key = files.graph_key(n.edges, objects="latest")
    cache.table(key, "objects", lambda: n.objects)
    return cache.table(key, "objects", lambda: n.objects.limit(0))


@query(_sql("SELECT s AS vid, count(*) AS degree, min(w) AS min_w, max(w) AS max_w FROM arcs GROUP BY s", ARCS))
def csv_report(n: Network) -> DataFrame:
    files.write_report(graph.degrees(n.edges), path := n.space.path("csv"))
    return n.spark.read.schema("vid long, degree long, min_w long, max_w long").option("header", True).csv(path)


@query(_sql("SELECT s AS vid, count(*) AS degree, min(w) AS min_w, max(w) AS max_w FROM arcs GROUP BY s", ARCS))
def json_report(n: Network) -> DataFrame:
    files.write_report(graph.degrees(n.edges), path := n.space.path("json"), "json")
    return n.spark.read.schema("vid long, degree long, min_w long, max_w long").json(path)


@query(_sql("SELECT sg_id, u, v, w FROM sg_edges", *SG))
def partition_cache(n: Network) -> DataFrame:
    """Loaded by a key of graph and options, else partitioned and saved; another option is another key."""
    cache = files.TableCache(n.spark, n.space.path("cache"))
    for size in (PART, PART + 1):
        cache.table(files.graph_key(n.edges, size=size), "edges", lambda size=size: partition.own_edges(n.edges, n.parts(size)))
    return cache.table(files.graph_key(n.edges, size=PART), "edges", lambda: n.edges.limit(0))


@query(_sql("SELECT a, b, min(d) AS w FROM clique WHERE a < b GROUP BY a, b", *CLIQUE))
def saved_index(n: Network) -> DataFrame:
    """The skeleton from tables that were saved and loaded."""
    Skeleton(_sg_edges(n)).persist().save(path := n.space.path("index"))
    return Skeleton.load(n.spark, path).skeleton()


# --- generators -----------------------------------------------------------------------------------

SOUND = "SELECT kind, n, CAST(0 AS BIGINT) AS unsound, places FROM (VALUES {}) AS t(kind, n, places)"


def _sound(n: Network, made: dict[str, DataFrame], free: tuple[str, ...] = ()) -> DataFrame:
    """(kind, n, unsound, places): rows, rows off the graph, and different places (null where chance decides)."""
    rows = None
    for kind, df in made.items():
        n_places = F.lit(None).cast("long") if kind in free else F.count_distinct(F.struct("u", "v", "offset_"))
        bad = queries.check_edges(df, n.edges).agg(F.count("*").alias("unsound"))
        one = df.agg(F.count("*").alias("n"), n_places.alias("places")).crossJoin(F.broadcast(bad)).select(F.lit(kind).alias("kind"), "n", "unsound", "places")  # two rows of one
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(SOUND.format(f"('random', {OBJECTS}, NULL::BIGINT), ('distinct', {OBJECTS}, {OBJECTS}), ('queries', 40, NULL), ('spread', {OBJECTS}, NULL), ('clustered', {OBJECTS}, NULL)"))
def generated_objects(n: Network) -> DataFrame:
    owned = n.space.table(_sg_edges(n), "owned")
    made = {
        "random": generators.random_objects(n.edges, OBJECTS), "distinct": generators.distinct_objects(n.edges, OBJECTS), "queries": generators.random_queries(n.edges, 40, RADIUS, K).withColumnRenamed("query_id", "obj_id"),
        "spread": generators.laid_out(owned, OBJECTS, "spread"), "clustered": generators.laid_out(owned, OBJECTS, "clustered"),
    }
    return _sound(n, {k: n.space.table(df, k) for k, df in made.items()}, ("random", "queries", "spread", "clustered"))


@query("SELECT kind, (SELECT count(DISTINCT user_id) FROM events) AS n, CAST(0 AS BIGINT) AS unsound, CAST(NULL AS BIGINT) AS places FROM (VALUES ('anywhere'), ('near')) AS t(kind)")
def moved_objects(n: Network) -> DataFrame:
    """All objects after a move, anywhere or to a neighbouring edge."""
    made = {"anywhere": positions.relocate(n.objects, n.edges, 3), "near": positions.move_locally(n.objects, n.edges, 3)}
    return _sound(n, {k: n.space.table(df, k) for k, df in made.items()}, tuple(made))


@query(
    _sql(
        """SELECT count(*) AS objects, CAST(0 AS BIGINT) AS apart, count(*) FILTER (EXISTS (
          SELECT 1 FROM v_edges e WHERE (e.u IN (o.u, o.v) OR e.v IN (o.u, o.v)) AND NOT (e.u = o.u AND e.v = o.v))) AS on_another_edge FROM v_objects o"""
    )
)
def local_moves_share_an_end(n: Network) -> DataFrame:
    """Every object that has a neighbouring edge to go to is on one."""
    moved = positions.move_locally(n.objects, n.edges, 5).select("obj_id", F.array("u", "v").alias("new"))
    both = moved.join(n.objects.select("obj_id", F.array("u", "v").alias("old")), "obj_id")
    return both.agg(F.count("*").alias("objects"), F.count_if(~F.arrays_overlap("new", "old")).alias("apart"), F.count_if(F.col("new") != F.col("old")).alias("on_another_edge"))


# --- distances ------------------------------------------------------------------------------------

ENDS = "ends_ AS (SELECT query_id * 2 AS k, u AS vid, offset_ AS dist FROM v_queries UNION ALL SELECT query_id * 2 + 1, v, w - offset_ FROM v_queries)"


@query(
    _sql(
        f"""SELECT query_id, vid, min(dist) AS dist, CAST(arg_min(origin, dist * 1000000000 + origin) AS BIGINT) AS origin FROM (
        SELECT f.k // 2 AS query_id, f.vid, f.dist, CASE WHEN f.k % 2 = 0 THEN q.u ELSE q.v END AS origin FROM both_ f JOIN v_queries q ON q.query_id = f.k // 2) WHERE dist <= {RADIUS} GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY query_id, vid"),
        ARCS, ENDS, _field("both_", "ends_", "k", "arcs a ON f.vid = a.s"),
    )
)
def field_origins(n: Network) -> DataFrame:
    """Of each vertex in reach the end of the query's edge that it is reached from (of equal ways the smaller vertex)."""
    return origins(queries.seeds(n.queries(RADIUS)), graph.arcs(n.edges))


@query(_sql("SELECT f.query_id, f.vid, f.dist FROM field f JOIN v_queries q ON q.query_id = (f.query_id + 1) % 5 AND f.vid IN (q.u, q.v)", *FIELD))
def target_distances(n: Network) -> DataFrame:
    """From each query to the ends of another's edge; the search ends when they are settled."""
    q = n.queries()
    others = q.select(F.pmod(F.col("query_id") - 1, F.lit(5)).alias("query_id"), F.explode(F.array("u", "v")).alias("vid"))
    return to_targets(queries.seeds(q), graph.arcs(n.edges), others)


# --- partitions -----------------------------------------------------------------------------------


@query(_sql(f"SELECT name, (SELECT count(*) FROM v_edges) AS graph_edges, CAST(0 AS BIGINT) AS missing_edges, CAST(0 AS BIGINT) AS ghost_edges, CAST(0 AS BIGINT) AS shared_edges, true AS within_theta FROM (VALUES ('grown'), ('merged')) AS t(name)"))
def growth_audit(n: Network) -> DataFrame:
    """Grown and merged partitions own each edge once, in subgraphs of at most so many vertices."""
    grown = n.space.table(partition.grow_parts(n.edges, THETA), "grown")
    rows = None
    for name, owned, theta in (("grown", grown, THETA), ("merged", n.space.table(partition.merge_small(grown, 2 * THETA), "merged"), 2 * THETA)):
        audit = reports.partition_audit(n.edges, owned)
        one = audit.select(F.lit(name).alias("name"), "graph_edges", "missing_edges", "ghost_edges", "shared_edges", (F.col("max_vertices") <= theta).alias("within_theta"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    _sql(
        """SELECT (SELECT count(*) FROM (SELECT DISTINCT a, b FROM clique WHERE a < b)) AS skeleton_edges, count(DISTINCT part) AS groups, count(DISTINCT vid) AS borders
        FROM (SELECT vid, vid // 100 AS part FROM (SELECT a AS vid FROM clique UNION SELECT b FROM clique))""",
        *CLIQUE,
    )
)
def hierarchy_probe(n: Network) -> DataFrame:
    """A partition of the skeleton itself."""
    edges = n.space.table(_skeleton(n).skeleton().select(F.col("a").alias("u"), F.col("b").alias("v"), "w"), "skeleton")
    parts = graph.vertices(edges).select("vid", F.expr("vid div 100").alias("part"))
    owned = n.space.table(partition.own_edges(edges, parts), "owned")
    shape = parts.agg(F.count_distinct("part").alias("groups"), F.count("*").alias("borders"))
    return owned.agg(F.count("*").alias("skeleton_edges")).crossJoin(F.broadcast(shape))  # two rows of one


@query(_sql("SELECT most, (SELECT count(DISTINCT sg_id) FROM ends) AS subgraphs, CAST(0 AS BIGINT) AS without_group, CAST(0 AS BIGINT) AS oversized FROM (VALUES (4), (8), (16), (32)) AS t(most)", *SG))
def hierarchy_groups(n: Network) -> DataFrame:
    """Groups of neighbouring subgraphs of several sizes: each subgraph is in one, and none is too large."""
    s = _skeleton(n)
    adjacency, ids = n.space.table(s.sg_adjacency(), "adjacency"), s.members.select("sg_id").distinct()
    rows = None
    for most in (4, 8, 16, 32):
        groups = n.space.table(group_subgraphs(adjacency, most), "groups")
        sizes = groups.groupBy("parent").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > most).alias("oversized"))
        lone = ids.join(groups, "sg_id", "left_anti").join(adjacency.select(F.explode(F.array("sg_a", "sg_b")).alias("sg_id")).distinct(), "sg_id", "left_semi")
        one = ids.agg(F.count("*").alias("subgraphs")).crossJoin(F.broadcast(lone.agg(F.count("*").alias("without_group")))).crossJoin(F.broadcast(sizes)).select(F.lit(most).alias("most"), "*")  # rows of one
        rows = one if rows is None else rows.unionByName(one)
    return rows


CLIQUE_LONG = _variant(CLIQUE, "parts|cut|sg_edges|ends|sg_vertices|sg_seeds|sg_arcs|sg_field|sg_dist|brd|clique", "_long", (f"/ {PART})", f"/ {LONG})"))


@query(_sql("SELECT sg_id, count(*) AS pairs, CAST(0 AS BIGINT) AS wrong FROM clique_long GROUP BY sg_id", *CLIQUE_LONG))
def hub_ways_are_exact(n: Network) -> DataFrame:
    """Pairs of borders of each subgraph, and those whose distance is another or none by way of hubs, where a subgraph keeps hubs."""
    s = Skeleton(partition.own_edges(n.edges, n.parts(LONG))).persist()
    to, back = hubs(s, least_borders=6, ratio=1.0)
    to = n.space.table(to, "hubs")
    back = to.select("sg_id", "hub", F.col("a").alias("b"), F.col("d").alias("e"))
    through = to.join(back, ["sg_id", "hub"]).where("a != b").groupBy("sg_id", "a", "b").agg(F.min(F.col("d") + F.col("e")).alias("way"))
    kept = to.select("sg_id").distinct().withColumn("kept", F.lit(True))
    both = s.clique().join(kept, "sg_id", "left").join(through, ["sg_id", "a", "b"], "left")
    return both.groupBy("sg_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("kept") & ~F.col("way").eqNullSafe(F.col("d"))).alias("wrong"))


# --- batches and epochs ---------------------------------------------------------------------------


@query(
    _sql(
        """SELECT v.radius, count(*) AS queries, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (
        SELECT q.query_id, v.radius, count(f.obj_id) AS n FROM v_queries q CROSS JOIN (VALUES (CAST(200 AS BIGINT)), (400), (800)) v(radius) LEFT JOIN found f ON f.query_id = q.query_id AND f.dist <= v.radius GROUP BY ALL) v GROUP BY v.radius""",
        *FIELD, FOUND,
    )
)
def range_batch(n: Network) -> DataFrame:
    """Result sizes of a batch of range queries at several radii, from one search at the widest."""
    return reports.batch_sizes(queries.exact_range(q := n.queries(RADIUS), n.objects, n.edges), q, [200, 400, RADIUS])


@query(
    _sql(
        """SELECT k, count(*) AS results, min(dist) AS nearest, max(dist) AS farthest, round(avg(dist), 6) AS mean FROM (SELECT query_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, obj_id) AS rnk FROM found)
        JOIN (VALUES (1), (5), (10)) t(k) ON rnk <= k GROUP BY k""",
        *FIELD, FOUND,
    )
)
def knn_batch(n: Network) -> DataFrame:
    """Distances of a batch of kNN queries for several k, from one search for the largest."""
    return reports.batch_distances(queries.exact_knn(n.queries(k=10), n.objects, n.edges), [1, 5, 10])


_EPOCH = f"v_epochs AS (SELECT p.*, CAST(event_id * {EPOCHS} // (SELECT max(event_id) + 1 FROM v_positions) AS BIGINT) AS epoch FROM v_positions p)"
_STATE = """v_states AS (SELECT e.epoch, p.obj_id, p.u, p.v, p.w, p.offset_ FROM (SELECT DISTINCT epoch FROM v_epochs) e JOIN v_epochs p ON p.epoch <= e.epoch
  QUALIFY row_number() OVER (PARTITION BY e.epoch, p.obj_id ORDER BY p.ts DESC, p.event_id DESC) = 1)"""
_COUNTS = f"""SELECT e.epoch, q.query_id, count(f.obj_id) AS result_count FROM (SELECT DISTINCT epoch FROM v_epochs) e CROSS JOIN v_queries q LEFT JOIN (
  SELECT f.query_id, s.epoch, s.obj_id FROM field f JOIN v_states s ON f.vid IN (s.u, s.v) GROUP BY f.query_id, s.epoch, s.obj_id
  HAVING min(CASE WHEN f.vid = s.u THEN f.dist + s.offset_ ELSE f.dist + s.w - s.offset_ END) <= {RADIUS}) f ON f.query_id = q.query_id AND f.epoch = e.epoch GROUP BY e.epoch, q.query_id"""


def _epochs(n: Network) -> DataFrame:
    last = n.positions.agg(F.max("event_id")).first()[0] + 1
    return n.positions.withColumn("epoch", F.expr(f"event_id * {EPOCHS} div {last}"))


@query(_sql(_COUNTS, *FIELD, _EPOCH, _STATE))
def maintained_counts(n: Network) -> DataFrame:
    """Counts of standing queries after each epoch of updates, kept by the changes alone; the SQL counts each epoch anew."""
    q = n.queries(RADIUS)
    index = n.space.table(positions.edge_index(positions.standing_fields(q, n.edges), n.edges, q), "index")
    return positions.epoch_counts(index, positions.effective(_epochs(n)), q)


@query(
    _sql(
        "SELECT epoch, count(*) AS updates, count(*) FILTER (fresh) AS applied, count(DISTINCT obj_id) FILTER (fresh) AS moved_objects FROM ("
        "SELECT epoch, obj_id, row_number() OVER (PARTITION BY obj_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NOT NULL AND NOT EXISTS ("
        "SELECT 1 FROM v_epochs o WHERE o.obj_id = p.obj_id AND o.event_id < p.event_id AND o.ts > p.ts) AS fresh FROM v_epochs p) GROUP BY epoch",
        _EPOCH,
    )
)
def update_epochs(n: Network) -> DataFrame:
    """Updates of each epoch, those that were not late, and the objects they moved."""
    rows = _epochs(n).join(positions.effective(_epochs(n)).select("event_id", F.lit(True).alias("fresh")), "event_id", "left")
    fresh = F.coalesce("fresh", F.lit(False))
    return rows.groupBy("epoch").agg(F.count("*").alias("updates"), F.count_if(fresh).alias("applied"), F.count_distinct(F.when(fresh, F.col("obj_id"))).alias("moved_objects"))


def _derived(n: Network, s: Skeleton) -> DerivedRows:
    """Derived rows after all epochs: the first has all of its objects, each later one those that moved in it."""
    moves = n.space.table(positions.effective(_epochs(n)), "moves")
    rows = DerivedRows(n.spark, n.space.path("derived"), s)
    for epoch in range(EPOCHS):
        rows.apply(positions.latest(moves.where(F.col("epoch") == epoch)))
    return rows


_COSTS = """SELECT o.obj_id, e.sg_id, x.border, min(CASE WHEN d.b = o.u THEN d.d + o.offset_ ELSE d.d + o.w - o.offset_ END) AS cost
        FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v JOIN brd x ON x.sg_id = e.sg_id JOIN sg_dist d ON d.sg_id = e.sg_id AND d.a = x.border AND d.b IN (o.u, o.v) GROUP BY ALL"""


@query(_sql(_COSTS, *SG_DIST))
def maintained_border_costs(n: Network) -> DataFrame:
    """Border costs kept up by the objects that moved; the SQL makes them anew."""
    return _derived(n, _skeleton(n)).table("costs")


@query(_sql(f"SELECT obj_id, sg_id, min(cost) AS suffix, arg_min(border, cost * 10000000 + border) AS border FROM ({_COSTS}) GROUP BY obj_id, sg_id", *SG_DIST))
def maintained_suffixes(n: Network) -> DataFrame:
    return _derived(n, _skeleton(n)).table("suffix")


@query(ORACLE_SQL["anchor_buckets"])
def maintained_buckets(n: Network) -> DataFrame:
    return _derived(n, _skeleton(n)).table("buckets")


# --- diagnostics ----------------------------------------------------------------------------------


@query(_sql(f"SELECT query_id, vid, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vid) AS settled, (SELECT count(*) FROM arcs a WHERE a.s = field.vid) AS relaxed FROM field WHERE dist <= {RADIUS}", *FIELD))
def settle_order(n: Network) -> DataFrame:
    """The order in which a search settles vertices, and how many arcs it tries at each."""
    return reports.settled(distances(queries.seeds(n.queries(RADIUS)), graph.arcs(n.edges)), n.edges)


@query(_sql("SELECT b.sg_id, count(*) AS external_edges, count(DISTINCT b.border) AS through FROM (SELECT sg_id, vid AS border FROM sg_vertices WHERE is_border) b JOIN sg_edges e ON b.border IN (e.u, e.v) AND e.sg_id <> b.sg_id GROUP BY b.sg_id", *SG))
def external_edges(n: Network) -> DataFrame:
    """Edges of other subgraphs at the borders of each."""
    return reports.external_edges(_sg_edges(n))


@query(
    _sql(
        f"""SELECT query_id, count(*) AS touched, round(count(*) FILTER (n = total) / count(*), 6) AS full_ratio, round(coalesce(sum(n) FILTER (n = total), 0) / sum(n), 6) AS object_ratio FROM (
        SELECT f.query_id, e.sg_id, count(*) AS n, max(t.n) AS total FROM found f JOIN v_objects o USING (obj_id) JOIN sg_edges e ON e.u = o.u AND e.v = o.v
        JOIN (SELECT sg_id, count(*) AS n FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v GROUP BY sg_id) t ON t.sg_id = e.sg_id WHERE f.dist <= {RADIUS} GROUP BY ALL) GROUP BY query_id""",
        *SG, *FIELD, FOUND,
    )
)
def coverage_scan(n: Network) -> DataFrame:
    """Of each query the shares of touched subgraphs and of found objects that lie in subgraphs found whole."""
    per = reports.coverage(queries.exact_range(n.queries(RADIUS), n.objects, n.edges), n.objects, _sg_edges(n))
    return per.select("query_id", "touched", F.round(F.col("full") / F.col("touched"), 6).alias("full_ratio"), F.round(F.col("full_objects") / F.col("result_objects"), 6).alias("object_ratio"))


@query(
    _sql(
        f"""SELECT l.query_id, c.obj_id, min(l.lb + c.suffix) AS lower_bound FROM (
          SELECT f.query_id, x.sg_id, min(f.dist) AS lb FROM field f JOIN brd x ON x.border = f.vid WHERE f.dist <= {RADIUS} GROUP BY ALL) l
        JOIN (SELECT o.obj_id, e.sg_id, min(CASE WHEN d.b = o.u THEN d.d + o.offset_ ELSE d.d + o.w - o.offset_ END) AS suffix
          FROM v_objects o JOIN sg_edges e ON e.u = o.u AND e.v = o.v JOIN brd x ON x.sg_id = e.sg_id JOIN sg_dist d ON d.sg_id = e.sg_id AND d.a = x.border AND d.b IN (o.u, o.v) GROUP BY ALL) c ON c.sg_id = l.sg_id GROUP BY l.query_id, c.obj_id""",
        *SG_DIST, *FIELD,
    )
)
def lower_bounds(n: Network) -> DataFrame:
    """Least distance of an object by way of the borders reached: that of its subgraph's nearest border and of the object's own."""
    s, q = _skeleton(n), n.queries(RADIUS)
    return s.lower_bounds(s.border_distances(q), n.objects)
