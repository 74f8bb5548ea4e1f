"""Hubs from packed subgraphs, and where searches find them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.operators import partition
from tarmac.operators.skeleton import Skeleton, hub_arcs, hubs
from tarmac.plans import blocks, fixpoint

EDGES = "u long, v long, w long"


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(5)
    rows = [(k, k + 1, rng.randint(3, 30)) for k in range(1, 300) if k % 10] + [(k, k + 10, rng.randint(3, 30)) for k in range(1, 291)]
    return spark.createDataFrame(rows, EDGES).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_hubs_shuffle_no_distances(spark, grid):
    owned = partition.own_edges(grid, partition.block_parts(grid, 30)).cache()
    s, plain = Skeleton(owned).persist(), Skeleton(owned, partition.all_pairs(owned)).persist()
    to, _ = hubs(s, least_borders=4, ratio=1.0)
    assert to.count() and rows(to) == rows(hubs(plain, least_borders=4, ratio=1.0)[0]) and "distances" not in s._tables
    # Picked as sets of pairs would have it: most uncovered pairs first, the smaller vertex of equal ones.
    d = {}
    for sg, a, b, x in s.from_borders().collect():
        d.setdefault(sg, {})[a, b] = x
    want = []
    for sg, far in d.items():
        border = sorted({a for a, _ in far})
        left = {(a, b) for a in border for b in border if a < b and (a, b) in far}
        pairs, used = len(left), set()
        serves = {h: {(a, b) for a, b in left if (a, h) in far and (b, h) in far and far[a, h] + far[b, h] == far[a, b]} for h in {b for _, b in far}}
        while left:
            hub = max(sorted(serves), key=lambda h: len(serves[h] & left))
            used |= {(a, hub) for pair in serves[hub] & left for a in pair}
            left -= serves[hub]
        if len(border) >= 4 and len(used) <= pairs:
            want += [(sg, a, h, far[a, h]) for a, h in used]
    assert rows(to) == sorted(want)


def test_hubs_lie_in_the_blocks_of_their_vertices(spark, grid, monkeypatch):
    monkeypatch.setattr(fixpoint, "LOCAL_ARCS", 1)
    monkeypatch.setattr(blocks, "BLOCK_ARCS", 400)
    s = Skeleton(partition.own_edges(grid, partition.block_parts(grid, 30))).persist()
    arcs = hub_arcs(s, s.space.table(hubs(s, least_borders=4, ratio=1.0)[0], "to"))
    roads = fixpoint.Roads(arcs)
    assert len(roads.blocks.cuts) and (roads.blocks.cuts >= 0).all()
    seeds = spark.createDataFrame([(0, s.border_sg.agg(F.min("border")).first()[0], 0, 150)], "query_id long, vid long, dist long, radius long")
    found = fixpoint.distances(seeds, roads).where("vid >= 0")
    assert rows(found) == rows(fixpoint.distances(seeds, s.roads("fixpoint")))
    assert np.array_equal(blocks.places(np.array([-1, -8, 7])), [0, 7, 7])
