"""Searches block by block equal plain ones, whatever the blocks."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from tarmac.functions import graph
from tarmac.operators import moving, queries
from tarmac.plans import blocks, fixpoint
from tarmac.plans.work import Workspace


@pytest.fixture(scope="module")
def roads(spark):
    rng = random.Random(31)
    names = rng.sample(range(1, 900), 120)  # numbers say little about where a vertex is
    rows = {tuple(sorted(rng.sample(names, 2))): rng.randint(1, 9) for _ in range(230)}
    rows |= {(k, k + 1): 3 for k in range(1000, 1060)}  # a line, far from the rest
    return [(u, v, w) for (u, v), w in rows.items()]


def search(edges, starts):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    best, heap = {}, [(d, x) for x, d in starts]
    heapq.heapify(heap)
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in near.get(x, []):
                heapq.heappush(heap, (d + w, y))
    return best


def asked_of(edges, radius):
    return [(q, *edges[q * 17 % len(edges)], 1, radius, 3) for q in range(9)] + [(9, 1000, 1001, 3, 2, radius, 3)]


SCHEMA = "query_id long, u long, v long, w long, offset_ long, radius long, k int"


@pytest.mark.parametrize("size,radius", [(100, 12), (200, None)])
def test_fields_equal_search(spark, roads, monkeypatch, size, radius):
    monkeypatch.setattr(blocks, "BLOCK_ARCS", size)
    monkeypatch.setattr(fixpoint, "LOCAL_ARCS", 1)
    edges, asked = spark.createDataFrame(roads, "u long, v long, w long"), asked_of(roads, radius)
    seeds = queries.seeds(spark.createDataFrame(asked, SCHEMA)).unionByName(spark.createDataFrame([(77, 5000, 2, radius)], "query_id long, vid long, dist long, radius long"))
    got = sorted(map(tuple, fixpoint.distances(seeds, graph.arcs(edges)).collect()))
    expected = [(77, 5000, 2)]  # no arcs
    for q, u, v, w, at, *_ in asked:
        expected += [(q, x, d) for x, d in search(roads, [(u, at), (v, w - at)]).items() if radius is None or d <= radius]
    assert got == sorted(expected)


@pytest.mark.parametrize("size", [150])
def test_searches_go_on_from_where_they_stopped(spark, roads, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_ARCS", size)
    edges, asked = spark.createDataFrame(roads, "u long, v long, w long"), asked_of(roads, 0)
    q = spark.createDataFrame(asked, SCHEMA)
    grown, found = fixpoint.Growing(queries.seeds(q), fixpoint.Roads(graph.arcs(edges), "blocks"), Workspace(spark, "test")), []
    for radius in (3, 11, 500):
        found += [(*r, radius) for r in grown.grow(q.select("query_id", F.lit(radius).alias("radius"))).collect()]
    expected = []
    for q_, u, v, w, at, *_ in asked:
        expected += [(q_, x, d, min(r for r in (3, 11, 500) if d <= r)) for x, d in search(roads, [(u, at), (v, w - at)]).items()]
    assert sorted(found) == sorted(expected) and grown.open().isEmpty()


def test_moved_queries_equal_new_searches(spark, roads, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ARCS", 150)
    edges, asked = spark.createDataFrame(roads, "u long, v long, w long"), asked_of(roads, 14)
    run = moving.MovingQueries(spark.createDataFrame(asked, SCHEMA), graph.arcs(edges), "blocks")
    run.move(spark.createDataFrame([(a[0], a[3]) for a in asked], "query_id long, offset_ long"))
    expected = []
    for q, u, v, w, *_ in asked:
        expected += [(q, x, d) for x, d in search(roads, [(u, w), (v, 0)]).items() if d <= 14]
    assert sorted(map(tuple, run.field.select("query_id", "vid", "dist").collect())) == sorted(expected)


def test_graphs_that_are_not_small_do_not_go_through_the_driver(spark):
    side = 300
    edges = spark.range(side * side).selectExpr("id + 1 AS u", "id % 7 + 1 AS w", f"explode(array(1, {side})) AS step").selectExpr("u", "u + step AS v", "w").where(f"v <= {side * side}")
    roads = fixpoint.Roads(graph.arcs(edges), "local")
    assert roads.sent is None and roads.blocks.table.count() == 2


def test_a_block_is_sent_no_oftener_than_it_is_asked(spark, roads, monkeypatch):
    asked = spark.createDataFrame([(q, 0) for q in range(90)] + [(0, 1), (1, 1), (0, 2)], "query_id long, block int")
    assert dict(map(tuple, blocks.shares(asked, 200).collect())) == {0: 90, 1: 2, 2: 1}
    assert dict(map(tuple, blocks.shares(asked, 4).collect())) == {0: 4, 1: 1, 2: 1}
    built, real = spark.sparkContext.accumulator(0), blocks.Block

    def counted(*of):
        built.add(1)
        return real(*of)

    monkeypatch.setattr(blocks, "Block", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        edges = spark.createDataFrame(roads, "u long, v long, w long")
        rows = fixpoint.distances(spark.createDataFrame([(1, roads[0][0], 0, 9)], "query_id long, vid long, dist long, radius long"), fixpoint.Roads(graph.arcs(edges), "blocks")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.vid: r.dist for r in rows} == {x: d for x, d in search(roads, [(roads[0][0], 0)]).items() if d <= 9} and built.value == 1
