"""Registered queries cover their whole tables."""

from __future__ import annotations

import heapq

import pytest

from tarmac import catalog
from tarmac.functions import graph
from tarmac.sources.network import Network

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["grown_partition", "merged_partition"])
def test_partitions_own_every_edge_once(spark, name):
    edges = sorted(map(tuple, Network(spark, FOLDER).edges.collect()))
    assert max(v for _, v, _ in edges) > 400
    assert sorted((r.u, r.v, r.w) for r in catalog.QUERIES[name](spark, FOLDER).collect()) == edges


@pytest.mark.parametrize("size", [15, 1_000_100])
def test_reweight_takes_the_exact_share_by_rank(spark, size):
    edges = spark.range(1, size + 1).selectExpr("id AS u", "id + 1 + id % 3 AS v", "10L AS w")
    rows = [(u, u + 1 + u % 3) for u in range(1, size + 1)]
    ranked = sorted(rows, key=lambda e: ((e[0] * (2654435761 + 1) + e[1] * (40503 + 2)) % 1000003, *e))
    new = graph.reweight(edges, 0.3, 1.5)
    assert new.count() == size
    got = {(r.u, r.v) for r in new.where("w = 15").collect()}
    assert got == set(ranked[: (3 * size + 5) // 10]) and new.where("w not in (10, 15)").count() == 0


def test_reweight_of_all_no_and_absent_edges(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 10)], "u long, v long, w long")
    assert [graph.reweight(e, f, 1.5).where("w = 15").count() for e, f in ((edges, 0.0), (edges, 1.0), (edges.limit(0), 0.5))] == [0, 2, 0]


def test_lookups_take_all_vertices_edges_and_objects(spark):
    n = Network(spark, FOLDER)
    edges, objects = [tuple(r) for r in n.edges.collect()], [tuple(r) for r in n.objects.collect()]
    rows = {name: sorted(map(tuple, catalog.QUERIES[name](spark, FOLDER).collect())) for name in ("neighbours", "objects_on_edges", "objects_at_vertices")}
    assert rows["neighbours"] == sorted([(u, v, w) for u, v, w in edges] + [(v, u, w) for u, v, w in edges])
    assert rows["objects_on_edges"] == sorted(objects)
    assert rows["objects_at_vertices"] == sorted([(o[1], o[0]) for o in objects] + [(o[2], o[0]) for o in objects])


def test_direct_range_has_a_query_at_every_object(spark):
    folder = "/root/testdata/sf0.001"
    n = Network(spark, folder)
    edges, objects = [tuple(r) for r in n.edges.collect()], [tuple(r) for r in n.objects.collect()]
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    expected = []
    for q, u, v, w, _ in objects:
        best, heap = {}, [(w - 1, u), (1, v)]
        while heap:
            d, x = heapq.heappop(heap)
            if x not in best and d <= catalog.NEAR:
                best[x] = d
                for y, more in near[x]:
                    heapq.heappush(heap, (d + more, y))
        for o, a, b, long, at in objects:
            ways = [best[x] + more for x, more in ((a, at), (b, long - at)) if x in best] + [abs(at - (w - 1))] * ((a, b) == (u, v))
            if ways and min(ways) <= catalog.NEAR:
                expected.append((q, o, min(ways)))
    assert sorted(map(tuple, catalog.QUERIES["range_direct"](spark, folder).collect())) == sorted(expected)
