"""Searches that end at their nearest targets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import partition, shortcuts
from tarmac.operators.skeleton import Skeleton
from tarmac.plans import fixpoint

EDGES = "u long, v long, w long"


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(5)
    rows = [(k, k + 1, rng.randint(3, 30)) for k in range(1, 300) if k % 10] + [(k, k + 10, rng.randint(3, 30)) for k in range(1, 291)]
    return spark.createDataFrame(rows, EDGES).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_nearest_targets_end_a_search(spark, grid):
    s = Skeleton(partition.own_edges(grid, partition.block_parts(grid, 5))).persist()
    far = s.space.table(shortcuts.representatives(s), "reps")
    pairs = far.select(F.col("sg_id").alias("query_id"), "rep").crossJoin(far.select(F.col("rep").alias("vid"))).where("rep != vid").select("query_id", "vid")
    seeds = far.select(F.col("sg_id").alias("query_id"), F.col("rep").alias("vid"), F.lit(0).cast("long").alias("dist"))
    some = fixpoint.to_targets(seeds, s.roads().arcs, pairs, nearest=2).cache()
    every = fixpoint.to_targets(seeds, s.roads().arcs, pairs).cache()
    by = {}
    for q, v, d in every.collect():
        by.setdefault(q, []).append((d, v))
    got = {}
    for q, v, d in some.collect():
        got.setdefault(q, set()).add((d, v))
    for q, all_of in by.items():
        second = sorted(all_of)[1][0]
        assert {p for p in all_of if p[0] <= second} <= got[q] <= set(all_of)
    assert some.count() < every.count()


def test_searches_without_enough_targets_end(spark):
    line = spark.createDataFrame([(k, k + 1, 1) for k in range(1, 9)] + [(9, 10, 500), (20, 21, 3)], EDGES)
    arcs = line.selectExpr("u AS s", "v AS d", "w").unionByName(line.selectExpr("v AS s", "u AS d", "w"))
    seeds = spark.createDataFrame([(0, 1, 0), (1, 20, 0), (2, 99, 0)], "query_id long, vid long, dist long")
    targets = spark.createDataFrame([(0, 3), (0, 10), (0, 20), (1, 21), (1, 1), (2, 1), (3, 1)], "query_id long, vid long")
    assert rows(fixpoint.to_targets(seeds, arcs, targets, nearest=2)) == [(0, 3, 2), (0, 10, 508), (1, 21, 3)]
