"""What packed subgraphs give equals what joins of their distances give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import partition
from tarmac.operators.skeleton import Skeleton


@pytest.mark.parametrize("dense", [256, 2])
def test_bounds_cliques_and_costs_without_shuffled_distances(spark, monkeypatch, dense):
    monkeypatch.setattr(partition, "DENSE", dense)
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample(range(1, 60), 2))): rng.randint(1, 30) for _ in range(110)} | {(100, 101): 4, (102, 103): 5}  # part 4 of 25 vertices is in pieces
    owned = spark.createDataFrame([(u % 5 if v < 100 else 4, u, v, w) for (u, v), w in edges.items()], "sg_id long, u long, v long, w long")
    members = partition.sg_vertices(owned)
    objects = owned.selectExpr("u * 1000 + v AS obj_id", "u", "v", "w", "1L AS offset_")
    s, plain = Skeleton(owned).persist(), Skeleton(owned, partition.all_pairs(owned)).persist()
    assert all("distances" not in t for t in s._tables)
    assert sorted(map(str, s.bounds().collect())) == sorted(map(str, partition.rb_ib(owned, partition.all_pairs(owned), members).collect()))
    for of in ("clique", "from_borders"):
        assert sorted(map(tuple, getattr(s, of)().collect())) == sorted(map(tuple, getattr(plain, of)().collect()))
    assert sorted(map(tuple, s.border_costs(objects).collect())) == sorted(map(tuple, plain.border_costs(objects).collect()))
    assert s.bounds().where(F.col("ib2").isNull()).count() > 0 and "distances" not in s._tables
