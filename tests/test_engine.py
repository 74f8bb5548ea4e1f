"""The engine on hand-made graphs, against an independent search, and over any partition."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tarmac.functions import graph
from tarmac.operators import partition, queries, reports
from tarmac.operators.skeleton import Skeleton, hubs
from tarmac.plans import fixpoint
from tarmac.plans.fixpoint import distances
from tarmac.sources import files, generators
from tarmac.streaming import positions

EDGES, OBJECTS, QUERY = "u long, v long, w long", "obj_id long, u long, v long, w long, offset_ long", "query_id long, u long, v long, w long, offset_ long, radius long, k int"
PATH = [(1, 2, 3), (2, 3, 2)]
STAR = [(1, 2, 10), (1, 3, 10), (10, 11, 5)]
CYCLE = [(1, 2, 4), (2, 3, 4), (3, 4, 4), (1, 4, 4)]


def search(edges, seeds):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    best, heap = {}, [(d, x) for x, d in seeds]
    while heap:
        d, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = d
        for y, w in near.get(x, ()):
            if y not in best:
                heapq.heappush(heap, (d + w, y))
    return best


def truth(edges, q, objects):
    best = search(edges, [(q[1], q[4]), (q[2], q[3] - q[4])])
    far = 10**15
    dist = {o[0]: min(best.get(o[1], far) + o[4], best.get(o[2], far) + o[3] - o[4]) for o in objects}
    return sorted((d, o) for o, d in dist.items() if d < far)


@pytest.fixture(scope="module")
def town():
    rng = random.Random(8)
    edges = [(x + 8 * y + 1, x + 8 * y + 2, rng.randint(2, 30)) for y in range(6) for x in range(7)]
    edges += [(x + 8 * y + 1, x + 8 * y + 9, rng.randint(2, 30)) for y in range(5) for x in range(8)]
    objects = [(k, *(e := rng.choice(edges)), rng.randint(1, e[2] - 1)) for k in range(60)]
    asked = [(k, *(e := rng.choice(edges)), rng.randint(0, e[2] - 1), rng.choice([5, 40, 90]), rng.choice([1, 5, 100])) for k in range(6)]
    return edges, objects, asked


@pytest.fixture(scope="module")
def tables(spark, town):
    return [spark.createDataFrame(rows, schema).cache() for rows, schema in zip(town, (EDGES, OBJECTS, QUERY))]


def knn_rows(df):
    return sorted((r.query_id, r.rnk, r.obj_id, r.dist) for r in df.collect())


@pytest.mark.parametrize("method", ["local", "fixpoint"])
def test_range_equals_search(tables, town, method):
    edges, objects, asked = tables
    got = sorted((r.query_id, r.obj_id, r.dist) for r in queries.exact_range(asked, objects, edges, method=method).collect())
    assert got == sorted((q[0], o, d) for q in town[2] for d, o in truth(town[0], q, town[1]) if d <= q[5])


def test_knn_equals_search(tables, town):
    edges, objects, asked = tables
    expected = sorted((q[0], n + 1, o, d) for q in town[2] for n, (d, o) in enumerate(truth(town[0], q, town[1])[: q[6]]))
    assert knn_rows(queries.exact_knn(asked, objects, edges)) == expected


@pytest.mark.parametrize("size", [3, 17])
def test_skeleton_equals_search_for_any_partition(tables, town, size):
    edges, objects, asked = tables
    s = Skeleton(partition.own_edges(edges, partition.block_parts(edges, size)).cache()).persist()
    got = sorted((r.query_id, r.obj_id) for r in s.range(asked, objects).collect())
    assert got == sorted((q[0], o) for q in town[2] for d, o in truth(town[0], q, town[1]) if d <= q[5])
    expected = sorted((q[0], n + 1, o, d) for q in town[2] for n, (d, o) in enumerate(truth(town[0], q, town[1])[: q[6]]))
    assert knn_rows(s.knn(asked, objects, 120)) == expected


def test_frontier_counts_borders_and_arcs(tables, town):
    edges, _, asked = tables
    borders = partition.sg_vertices(partition.own_edges(edges, partition.block_parts(edges, 8))).where("is_border")
    marked = {r.vid for r in borders.collect()}
    for r in queries.frontier(asked, edges, [30, 60], borders).collect():
        q = town[2][r.query_id]
        best = {x: d for x, d in search(town[0], [(q[1], q[4]), (q[2], q[3] - q[4])]).items() if d <= r.radius}
        out = [(x, d + w) for u, v, w in town[0] for x, d in [(u, best.get(u)), (v, best.get(v))] if d is not None and d + w > r.radius]
        assert (r.reached, r.outward_arcs, r.frontier_vertices) == (len(best), len(out), len({x for x, _ in out}))
        assert r.frontier_borders == len({x for x, _ in out} & marked)


def test_positions_on_vertices(spark):
    rows = spark.createDataFrame([(0, 1, 2, 9), (9, 1, 2, 9), (4, 1, 2, 9)], "offset_ long, u long, v long, w long")
    assert [r.v for r in rows.select(graph.query_vertex(F.col("offset_"), F.col("u"), F.col("v"), F.col("w")).alias("v")).collect()] == [1, 2, None]


def test_origins_and_targets(tables, town):
    edges, _, asked = tables
    roads = graph.arcs(edges)
    far = asked.drop("radius")
    for r in fixpoint.origins(queries.seeds(far), roads).collect():
        q = town[2][r.query_id]
        ways = sorted((search(town[0], [(x, d)])[r.vid], x) for x, d in ((q[1], q[4]), (q[2], q[3] - q[4])))
        assert (r.dist, r.origin) == ways[0]
    wanted = far.select("query_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 48, 999)])).alias("vid"))
    got = {(r.query_id, r.vid): r.dist for r in fixpoint.to_targets(queries.seeds(far), roads, wanted).collect()}
    assert got == {(q[0], x): search(town[0], [(q[1], q[4]), (q[2], q[3] - q[4])])[x] for q in town[2] for x in (1, 48)}


def test_same_edge_modes(spark):
    edges = spark.createDataFrame([(1, 2, 10)], EDGES)
    q = spark.createDataFrame([(0, 1, 2, 10, 4, 20, 1)], QUERY)
    o = spark.createDataFrame([(7, 1, 2, 10, 6)], OBJECTS)
    assert queries.exact_range(q, o, edges).first().dist == 10
    assert queries.exact_range(q, o, edges, same_edge="direct").first().dist == 2


def test_ties_and_unreachable_objects(spark):
    edges = spark.createDataFrame(STAR, EDGES)
    o = spark.createDataFrame([(7, 1, 3, 10, 3), (4, 1, 3, 10, 3), (9, 10, 11, 5, 2)], OBJECTS)
    q = spark.createDataFrame([(0, 1, 2, 10, 5, 8, 1), (1, 1, 2, 10, 5, 8, 5), (2, 1, 2, 10, 5, 8, 0)], QUERY)
    assert knn_rows(queries.exact_knn(q, o, edges)) == [(0, 1, 4, 8), (1, 1, 4, 8), (1, 2, 7, 8)]
    assert queries.exact_range(q.where("query_id = 0"), o, edges).count() == 2
    assert queries.exact_knn(q, o.limit(0), edges).count() == 0


def test_reentry(spark):
    edges = spark.createDataFrame([(0, 1, 2, 10), (0, 2, 3, 100), (1, 2, 4, 1), (1, 3, 4, 1)], "sg_id long, u long, v long, w long")
    q = spark.createDataFrame([(0, 1, 2, 10, 5, 20, 1)], QUERY)
    o = spark.createDataFrame([(3, 2, 3, 100, 90)], OBJECTS)
    assert queries.exact_range(q, o, edges.drop("sg_id")).first().dist == 17


def test_bounds(spark):
    path = spark.createDataFrame([(0, *e) for e in PATH] + [(1, 1, 9, 1), (2, 3, 8, 1)], "sg_id long, u long, v long, w long")
    rows = {r.border: (r.rb2, r.ib2, r.br_ok) for r in partition.rb_ib(path, partition.all_pairs(path)).where("sg_id = 0").collect()}
    assert rows == {1: (10, 10, True), 3: (10, 10, True)}
    md = {r.vid: r.md for r in partition.nearest_border(partition.all_pairs(path), partition.sg_vertices(path)).where("sg_id = 0").collect()}
    assert md == {1: 0, 2: 2, 3: 0}
    far = spark.createDataFrame([(0, 1, 2, 1), (0, 1, 3, 10), (0, 2, 3, 10), (1, 1, 9, 1), (2, 2, 8, 1)], "sg_id long, u long, v long, w long")
    rows = {r.border: (r.rb2, r.ib2, r.br_ok) for r in partition.rb_ib(far, partition.all_pairs(far)).where("sg_id = 0").collect()}
    assert rows == {1: (2, 21, False), 2: (2, 21, False)}
    assert partition.distal_point(2, 3, 4) == 9


def test_table_updates_equal_a_rebuild(spark):
    before = spark.createDataFrame([(0, *e) for e in CYCLE], "sg_id long, u long, v long, w long")
    dist = partition.all_pairs(before)
    new = spark.createDataFrame([(0, 1, 3, 2)], "sg_id long, u long, v long, w long")
    rows = lambda d: sorted(map(tuple, d.select("sg_id", "a", "b", "d").collect()))
    assert rows(partition.insert_edge(dist, new)) == rows(partition.all_pairs(before.union(new)))
    leaf = spark.createDataFrame([(0, 2, 7, 5)], "sg_id long, attach long, vid long, w long")
    assert rows(partition.add_leaf(dist, leaf)) == rows(partition.all_pairs(before.union(spark.createDataFrame([(0, 2, 7, 5)], before.schema))))


def test_grown_partitions_cover_each_edge_once(tables):
    edges = tables[0]
    grown = partition.grow_parts(edges, 8).cache()
    audit = reports.partition_audit(edges, grown).first()
    assert (audit.missing_edges, audit.ghost_edges, audit.shared_edges) == (0, 0, 0)
    merged = partition.merge_small(grown, 16)
    audit = reports.partition_audit(edges, merged).first()
    assert (audit.missing_edges, audit.ghost_edges, audit.shared_edges) == (0, 0, 0)


def test_border_demotion_keeps_br(tables):
    edges = tables[0]
    owned = partition.own_edges(edges, partition.block_parts(edges, 8)).cache()
    dist = partition.all_pairs(owned).cache()
    pinned = partition.sg_vertices(owned).withColumn("is_border", F.lit(True))
    fewer = partition.minimize_borders(owned, dist, pinned)
    assert fewer.where("is_border").count() <= pinned.count()
    lost = partition.sg_vertices(owned).where("is_border").join(fewer.where("is_border"), ["sg_id", "vid"], "left_anti")
    assert lost.count() == 0


def test_graph_operations(spark):
    edges = graph.canonical(spark.createDataFrame([(2, 1, 5), (1, 2, 3), (2, 3, 4)], EDGES))
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 3), (2, 3, 4)]
    assert graph.validate(spark.createDataFrame([(2, 2, 1), (0, 1, 1), (1, 2, 0), (1, 2, 1)], EDGES)).count() == 3
    assert graph.disconnect(edges, spark.createDataFrame([(2, 1)], "u long, v long")).count() == 1
    assert graph.lookup(edges, spark.createDataFrame([(3, 2), (1, 3)], "a long, b long").orderBy("a")).where("has_edge").count() == 1
    up, down = graph.reweight(edges, 1.0, 1.5).orderBy("u").collect(), graph.reweight(edges, 1.0, 0.1, increase=False).collect()
    assert [r.w for r in up] == [5, 6] and {r.w for r in down} == {1}


def test_files_round_trip(spark, tables, tmp_path):
    edges, objects, _ = tables
    files.write_graph(edges, f"{tmp_path}/g")
    assert sorted(map(tuple, files.read_graph(spark, f"{tmp_path}/g").collect())) == sorted(map(tuple, edges.collect()))
    (tmp_path / "x.gr").write_text("c text\np sp 2 2\na 1 2 5\na 2 1 5\n\nq what\n")
    with pytest.raises(Exception, match="not a graph line"):
        files.read_graph(spark, f"{tmp_path}/x.gr").count()
    assert files.read_graph(spark, f"{tmp_path}/x.gr", strict=False).count() == 1
    (tmp_path / "x.co").write_text("c text\nv 1 0.5 2\nv 2 1 3\n")
    assert files.read_coordinates(spark, f"{tmp_path}/x.co").count() == 2
    (tmp_path / "x.csv").write_text("vertex_id,part\n1,0\n2,1\n")
    assert files.read_assignment(spark, f"{tmp_path}/x.csv").count() == 2
    files.write_objects(objects, f"{tmp_path}/o")
    back = files.read_objects(spark, f"{tmp_path}/o").orderBy("obj_id").collect()
    assert [(r.obj_id, r.u, r.v, r.offset_) for r in back] == sorted((r.obj_id, r.u, r.v, r.offset_) for r in objects.collect())
    cache = files.TableCache(spark, f"{tmp_path}/cache")
    key = files.graph_key(edges, theta=8)
    assert key == files.graph_key(edges.repartition(5), theta=8) != files.graph_key(edges, theta=9)
    assert cache.table(key, "e", lambda: edges).count() == cache.table(key, "e", lambda: edges.limit(0)).count()


def test_generators(tables):
    edges = tables[0]
    slots = edges.agg(F.sum(F.col("w") - 1)).first()[0]
    some = generators.random_objects(edges, 50)
    assert some.count() == 50 and queries.check_edges(some, edges).count() == 0
    every = generators.distinct_objects(edges, slots)
    assert every.select("u", "v", "offset_").distinct().count() == slots
    with pytest.raises(ValueError):
        generators.distinct_objects(edges, slots + 1)
    owned = partition.own_edges(edges, partition.block_parts(edges, 8))
    for layout in ("spread", "clustered"):
        assert generators.laid_out(owned, 30, layout).count() == 30


def test_standing_queries_follow_updates(spark, tables, town):
    edges, objects, asked = tables
    rng = random.Random(5)
    rows, event = [], 0
    for k in range(200):
        e = rng.choice(town[0])
        rows.append((event := event + 1, rng.randint(0, 50), rng.randint(0, 20), *e, rng.randint(1, e[2] - 1)))
    log = spark.createDataFrame(rows, "event_id long, ts long, obj_id long, u long, v long, w long, offset_ long")
    now = positions.latest(log)
    field = positions.standing_fields(asked, edges).cache()
    count = {r.query_id: r.result_count for r in positions.counts(field, now, asked).collect()}
    moves = positions.transitions(log).cache()
    assert {r.query_id: r.delta for r in positions.deltas_by_query(field, moves, asked).collect()} == count
    assert {r.query_id: r.delta for r in positions.deltas_by_edge(positions.edge_index(field, edges, asked), moves, asked).collect()} == count
    assert sorted(map(tuple, positions.latest(log.union(log)).collect())) == sorted(map(tuple, now.collect()))
    local = positions.move_locally(objects, edges, 1)
    assert local.count() == objects.count() and queries.check_edges(local, edges).count() == 0


def test_streamed_positions(spark, tmp_path):
    schema = "event_id long, ts long, obj_id long, u long, v long, w long, offset_ long"
    first = [(1, 1, 1, 1, 2, 3, 1), (2, 3, 1, 2, 3, 2, 1)]
    late = [(3, 2, 1, 1, 2, 3, 2), (4, 5, 2, 1, 2, 3, 2), (2, 3, 1, 2, 3, 2, 1)]
    job = positions.LatestPositions(spark, f"{tmp_path}/job")
    for rows in (first, late):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/log")
        job.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"))
    assert sorted(map(tuple, job.table().collect())) == [(1, 2, 3, 2, 1), (2, 1, 2, 3, 2)]
    assert len([p for p in (tmp_path / "job" / "latest").iterdir() if p.is_dir()]) == 1


def test_hubs_are_exact(tables):
    owned = partition.own_edges(tables[0], partition.block_parts(tables[0], 16)).cache()
    s = Skeleton(owned).persist()
    to, back = hubs(s, least_borders=4, ratio=1.0)
    through = to.join(back.withColumnRenamed("d", "e"), ["sg_id", "hub"]).where("a != b").groupBy("sg_id", "a", "b").agg(F.min(F.col("d") + F.col("e")).alias("x"))
    assert through.join(s.clique(), ["sg_id", "a", "b"]).where("x < d").count() == 0


def test_resource_bound_plan_falls_back(tables, monkeypatch):
    edges, _, asked = tables
    local = sorted(map(tuple, distances(queries.seeds(asked), graph.arcs(edges)).collect()))
    monkeypatch.setattr(fixpoint, "LOCAL_ARCS", 1)
    assert sorted(map(tuple, distances(queries.seeds(asked), graph.arcs(edges)).collect())) == local
