"""Searches that go on, thresholds, moves, streams and derived rows, against searches and recounts of their own."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_engine import EDGES, OBJECTS, QUERY, search, truth

from tarmac.functions import graph
from tarmac.operators import moving, partition, queries, shortcuts, whatif
from tarmac.operators.skeleton import Skeleton, hub_arcs, hubs
from tarmac.plans import fixpoint
from tarmac.plans.order import numbered
from tarmac.plans.work import Workspace
from tarmac.streaming import positions
from tarmac.streaming.derived import DerivedRows


@pytest.fixture(scope="module")
def town():
    rng = random.Random(3)
    edges = [(x + 7 * y + 1, x + 7 * y + 2, rng.randint(3, 25)) for y in range(6) for x in range(6)]
    edges += [(x + 7 * y + 1, x + 7 * y + 8, rng.randint(3, 25)) for y in range(5) for x in range(7)]
    edges += [(100, 101, 9), (101, 102, 4)]  # a component of its own
    objects = [(k, *(e := rng.choice(edges)), rng.randint(1, e[2] - 1)) for k in range(50)]
    asked = [(k, *(e := rng.choice(edges)), rng.randint(0, e[2] - 1), rng.choice([5, 40, 70]), rng.choice([1, 4, 100])) for k in range(8)]
    return edges, objects, asked


@pytest.fixture(scope="module")
def tables(spark, town):
    return tuple(spark.createDataFrame(rows, schema).cache() for rows, schema in zip(town, (EDGES, OBJECTS, QUERY)))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("method", ["local", "fixpoint"])
def test_each_vertex_is_settled_once(spark, town, tables, method):
    edges, _, asked = town
    space = Workspace(spark, "test")
    grown = fixpoint.Growing(queries.seeds(tables[2]), fixpoint.Roads(graph.arcs(tables[0]), method), space)
    found, ids = [], tables[2].select("query_id")
    for radius in (6, 30, 31, 500):
        some = ids if radius != 30 else ids.where("query_id % 2 = 0")  # others wait
        found += [(*r, radius) for r in rows(grown.grow(some.withColumn("radius", F.lit(radius))))]
    assert len({r[:2] for r in found}) == len(found)
    for q in asked:
        best = search(edges, [(q[1], q[4]), (q[2], q[3] - q[4])])
        steps = [6, 30, 31, 500] if q[0] % 2 == 0 else [6, 31, 500]
        assert sorted(r[1:] for r in found if r[0] == q[0]) == sorted((v, d, min(s for s in steps if d <= s)) for v, d in best.items())
    assert grown.open().isEmpty()


def test_a_batch_is_many_tasks(spark, tables):
    asked = spark.range(1000).select(F.col("id").alias("query_id"), F.lit(1).alias("u"), F.lit(2).alias("v"), F.lit(9).alias("w"), F.lit(1).alias("offset_"), F.lit(5).alias("radius"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = fixpoint.distances(queries.seeds(asked), graph.arcs(tables[0]))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == parts > 1
    owned = partition.own_edges(tables[0], partition.block_parts(tables[0], 3))
    assert partition.all_pairs(owned).select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("size,shift", [(7, 0), (5, 2), (1000, 0)])
def test_threshold_knn_over_any_partition(spark, town, tables, size, shift):
    edges, objects, asked = town
    owned = partition.own_edges(tables[0], partition.block_parts(tables[0], size, shift)).cache()
    s = Skeleton(owned).persist()
    expected = sorted((q[0], k + 1, o, d) for q in asked for k, (d, o) in enumerate(truth(edges, q, objects)[: q[6]]))
    assert rows(s.threshold_knn(tables[2], tables[1], 4)) == expected
    scored = s.scored
    assert scored.groupBy("query_id", "obj_id").count().where("count > 1").isEmpty()
    near = tables[2].where("k <= 4")
    few = s.threshold_knn(near, tables[1], 4)
    if size == 7:
        pairs = set()
        real = s.space.table

        def table(df, label):
            out = real(df, label)
            if label == "near":
                pairs.update((r.query_id, r.obj_id) for r in out.collect())
            return out

        s.space.table = table
        assert rows(s.knn(near, tables[1], 4)) == rows(few)
        s.space.table = real
        assert s.scored.count() < len(pairs)


def test_admitted_objects_are_among_the_nearest(town, tables):
    edges, objects, asked = town
    s = Skeleton(partition.own_edges(tables[0], partition.block_parts(tables[0], 7))).persist()
    for k in (20, 50):
        wide = tables[2].withColumn("radius", F.lit(200)).withColumn("k", F.lit(k))
        got = rows(s.admitted(wide, tables[1]).select("query_id", "obj_id"))
        exact = {(q[0], o) for q in asked for _, o in truth(edges, q, objects)[:k]}
        assert set(got) <= exact and len(got) == len(set(got)) and (got or k < 50)


@pytest.mark.parametrize("method", ["local", "fixpoint"])
def test_moves_equal_new_searches(town, tables, method):
    edges, objects, asked = town
    rng = random.Random(5)
    run = moving.MovingQueries(tables[2], graph.arcs(tables[0]), method)
    now = {q[0]: list(q) for q in asked}
    for turn in range(3 if method == "local" else 2):
        moves = [(i, rng.randint(0, q[3])) for i, q in now.items() if rng.random() < 0.8]
        searched = run.move(tables[2].sparkSession.createDataFrame(moves, "query_id long, offset_ long"))
        for i, offset in moves:
            now[i][4] = offset
        field = run.field.collect()
        for i, q in now.items():
            left, right = search(edges, [(q[1], q[4])]), search(edges, [(q[2], q[3] - q[4])])
            best = search(edges, [(q[1], q[4]), (q[2], q[3] - q[4])])
            own = {r.vid: (r.dist, r.side) for r in field if r.query_id == i}
            assert {v: d for v, (d, _) in own.items()} == {v: d for v, d in best.items() if d <= q[5]}
            assert all((left if side == "l" else right)[v] == d for v, (d, side) in own.items())
        assert searched.count() < len(field) and searched.join(run.field, ["query_id", "vid", "dist"], "left_anti").isEmpty()
        expected = sorted((q[0], o, d) for q in now.values() for d, o in truth(edges, q, objects) if d <= q[5])
        assert rows(run.results(tables[1])) == expected


def log_of(town, n=120):
    rng = random.Random(9)
    out = []
    for k in range(n):
        u, v, w = rng.choice(town[0])
        out.append((k, datetime(2024, 1, 1, 0, 0, rng.randrange(60)), rng.randrange(12), u, v, w, rng.randint(1, w - 1)))
    return out


LOG = "event_id long, ts timestamp, obj_id long, u long, v long, w long, offset_ long"


@pytest.mark.parametrize("splits", [[120], [1, 60, 59], [30] * 4])
def test_streamed_counts_equal_a_recount(spark, town, tables, tmp_path, monkeypatch, splits):
    monkeypatch.setattr(positions, "MERGE", 1)
    asked = tables[2]
    field = positions.standing_fields(asked, tables[0])
    index = positions.edge_index(field, tables[0], asked).cache()
    job, log = positions.StandingCounts(spark, f"{tmp_path}/job", index, asked), log_of(town)
    assert {r.result_count for r in job.counts().collect()} == {0}
    done = 0
    for k, size in enumerate(splits):
        again = log[:done][::9]  # rows that were there already
        spark.createDataFrame(log[done : done + size] + again, LOG).repartition(2).write.mode("append").parquet(f"{tmp_path}/log")
        done += size
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1 + k).parquet(f"{tmp_path}/log")
        job.run(stream)
        now = positions.latest(spark.createDataFrame(log[:done], LOG))
        assert rows(job.counts()) == rows(positions.counts(field, now, asked))


def test_derived_rows_follow_the_moves(spark, town, tables, tmp_path):
    owned = partition.own_edges(tables[0], partition.block_parts(tables[0], 7))
    s = Skeleton(owned).persist()
    kept, rng = DerivedRows(spark, f"{tmp_path}/derived", s), random.Random(6)
    state = {o[0]: o for o in town[1]}
    kept.apply(tables[1])
    for turn in range(3):
        moved = {i: (i, *(e := rng.choice(town[0])), rng.randint(1, e[2] - 1)) for i in rng.sample(sorted(state), 4)}
        gone = sorted(set(state) - set(moved))[:1] if turn == 1 else []
        state.update(moved)
        for i in gone:
            del state[i]
        kept.apply(spark.createDataFrame(list(moved.values()), OBJECTS), spark.createDataFrame([(i,) for i in gone], "obj_id long") if gone else None)
        if turn == 2:
            assert kept.written(3)["places"] == 4 and kept.written(3)["costs"] <= 4 * 30 and kept.written(3)["buckets"] <= 24
            kept.compact()
        now = spark.createDataFrame(list(state.values()), OBJECTS)
        assert rows(kept.table("costs")) == rows(s.border_costs(now))
        assert rows(kept.table("suffix")) == rows(s.suffix(now))
        key = lambda df: Counter((r["kind"], r.key_u, r.key_v, r.n) for r in df.collect())
        assert key(kept.table("buckets")) == key(positions.anchor_buckets(now))
    kept.apply(spark.createDataFrame([town[1][0]], OBJECTS))
    assert kept.table("places").count() == len(state | {0: None})


def test_shortcuts_change_no_distance_and_save_rounds(spark, tables):
    line = spark.createDataFrame([(k, k + 1, 1 + k % 4) for k in range(1, 40)], EDGES)
    s = Skeleton(partition.own_edges(line, partition.block_parts(line, 2))).persist()
    added = shortcuts.shortcuts(s, 4, 2).cache()
    assert added.count() > 20
    wide = spark.createDataFrame([(0, 1, 2, 2, 1, 200, 1), (1, 20, 21, 1, 0, 30, 1)], QUERY)
    plain, quick = s.roads().arcs, shortcuts.with_shortcuts(s.roads().arcs, added).cache()
    assert rows(s.border_distances(wide)) == rows(s.border_distances(wide, arcs=quick))
    steps = []
    for arcs in (plain, quick):
        far = wide.where("query_id = 0")
        space = Workspace(spark, "rounds")
        labels, real = [], space.table
        space.table = lambda df, label, labels=labels, real=real: labels.append(label) or real(df, label)
        start = s.entry(far).join(s.border_sg.select("sg_id", F.col("border").alias("vid")), ["sg_id", "vid"], "left_semi").select("query_id", "vid", "dist", F.lit(200).cast("long").alias("radius"))
        fixpoint.rounds_of(space, start.groupBy("query_id", "vid").agg(F.min("dist").alias("dist"), F.max("radius").alias("radius")), arcs, None)
        steps.append(labels.count("step"))
    assert steps[1] < steps[0]


def test_hub_ways_and_demotions(spark, town, tables):
    s = Skeleton(partition.own_edges(tables[0], partition.block_parts(tables[0], 14))).persist()
    to, _ = hubs(s, least_borders=4, ratio=1.0)
    wide = tables[2].withColumn("radius", F.lit(60))
    to = s.space.table(to, "to")
    assert to.count() and rows(s.border_distances(wide, arcs=hub_arcs(s, to))) == rows(s.border_distances(wide))
    # A vertex that is no border of a subgraph for others is reached as before; without a border of the only way in, all behind it is lost.
    line = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (3, 4, 5), (4, 5, 5)], EDGES)
    owned = line.withColumn("sg_id", F.when(F.col("v") <= 3, 0).otherwise(1).cast("long")).select("sg_id", "u", "v", "w")
    own = Skeleton(owned).persist()
    q = spark.createDataFrame([(0, 1, 2, 5, 1, 30, 1)], QUERY)
    objects = spark.createDataFrame([(1, 2, 3, 5, 2), (2, 3, 4, 5, 1), (3, 4, 5, 5, 4)], OBJECTS)
    got = rows(whatif.demotion_verdicts(own, q, objects, own.border_sg))
    assert got == [(0, 3, 3, 2, 0, False), (1, 3, 3, 2, 0, False)]


def test_minimize_borders_by_hand(spark):
    rng = random.Random(2)
    for turn in range(4):
        n = 9
        edges = sorted({(min(a, b), max(a, b)) for a, b in [(k, rng.randint(1, k - 1)) for k in range(2, n + 1)] + [tuple(rng.sample(range(1, n + 1), 2)) for _ in range(4)]})
        weights = [(u, v, rng.randint(1, 9)) for u, v in edges]
        outside = [(1, 50, 3), (2, 51, 3)]
        marked = {1, 2, *rng.sample(range(3, n + 1), 5)}

        def holds(borders, weights=weights):
            for b in borders:
                best = search(weights, [(b, 0)])
                if 2 * max(best[o] for o in borders) < max(best[u] + best[v] + w for u, v, w in weights):
                    return False
            return True

        expected = set(marked)
        for b in sorted(marked - {1, 2}):
            if len(expected) > 2 and holds(expected - {b}):
                expected.discard(b)
        owned = spark.createDataFrame([(0, *e) for e in weights] + [(1, *e) for e in outside], "sg_id long, u long, v long, w long")
        members = partition.sg_vertices(owned).withColumn("is_border", F.col("vid").isin(sorted(marked)) & (F.col("sg_id") == 0))
        got = partition.minimize_borders(owned.where("sg_id = 0 or sg_id = 1"), partition.all_pairs(owned), members)
        assert {r.vid for r in got.where("sg_id = 0 and is_border").collect()} == expected


def test_large_subgraphs_one_vertex_at_a_time(spark, tables, monkeypatch):
    owned = partition.own_edges(tables[0], partition.block_parts(tables[0], 20)).toPandas()
    batch = owned.groupby("sg_id")[["u", "v", "w"]].apply(lambda g: g.to_dict("records")).reset_index(name="edges")
    import pyarrow as pa

    arrow = pa.RecordBatch.from_pandas(batch, preserve_index=False)
    dense = sorted(map(tuple, pa.Table.from_batches(partition._all_pairs(iter([arrow]))).to_pandas().to_numpy().tolist()))
    monkeypatch.setattr(partition, "DENSE", 1)
    assert sorted(map(tuple, pa.Table.from_batches(partition._all_pairs(iter([arrow]))).to_pandas().to_numpy().tolist())) == dense


def test_numbers_without_a_window_over_all(spark):
    space = Workspace(spark, "order")
    rows_ = space.table(spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("key"), "id"), "rows")
    found = numbered(rows_, [F.col("key").desc(), F.col("id")], "n", space)
    got = sorted((r.n, r.key, r["id"]) for r in found.collect())
    want = sorted(((7 if k % 3 == 0 else k % 11), k) for k in range(5000))
    want.sort(key=lambda r: (-r[0], r[1]))
    assert got == [(n, *r) for n, r in enumerate(want)]
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2500  # 7 is a third of all keys
    assert numbered(space.table(rows_.limit(0), "none"), [F.col("id")], "n", space).count() == 0
