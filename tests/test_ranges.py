"""Growth and merging of partitions by ranges of a graph."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarmac.operators import partition, reports

EDGES = "u long, v long, w long"


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(5)
    rows = [(k, k + 1, rng.randint(3, 30)) for k in range(1, 300) if k % 10] + [(k, k + 10, rng.randint(3, 30)) for k in range(1, 291)]
    return spark.createDataFrame(rows, EDGES).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_growth_and_merging_go_by_ranges(spark, grid, monkeypatch):
    monkeypatch.setattr(partition, "GROWN_EDGES", 60)
    monkeypatch.setattr(partition, "MERGED_SUBGRAPHS", 20)
    grown = partition.grow_parts(grid, 8).cache()
    assert grown.select(F.expr(f"sg_id div {partition.RANGE_IDS}")).distinct().count() > 4
    audit = reports.partition_audit(grid, grown).first()
    assert (audit.missing_edges, audit.ghost_edges, audit.shared_edges) == (0, 0, 0) and audit.max_vertices <= 8
    merged = partition.merge_small(grown, 16).cache()
    audit = reports.partition_audit(grid, merged).first()
    assert (audit.missing_edges, audit.ghost_edges, audit.shared_edges) == (0, 0, 0) and audit.max_vertices <= 16
    # Some merges cross ranges of growth, and no pair of a small subgraph that still fits is left.
    assert merged.join(grown.withColumnRenamed("sg_id", "old"), ["u", "v", "w"]).groupBy("sg_id").agg(F.count_distinct(F.expr(f"old div {partition.RANGE_IDS}")).alias("n")).where("n > 1").count()
    owner, old = {}, {}
    for sg, u, v, w in merged.collect():
        owner[u, v] = sg
    for sg, u, v, w in grown.collect():
        old.setdefault(sg, set()).update((u, v))
        old.setdefault((sg,), owner[u, v])
    size = {}
    for sg in [x for x in old if not isinstance(x, tuple)]:  # as the capacity counts: a vertex less for each merge
        size[old[sg,]] = size.get(old[sg,], 1) + len(old[sg]) - 1
    for a, b in itertools.permutations([x for x in old if not isinstance(x, tuple)], 2):
        if len(old[a]) <= 3 and old[a] & old[b] and old[a,] != old[b,]:
            assert size[old[a,]] + size[old[b,]] - 1 > 16


def test_a_range_alone_is_grown_as_before(grid):
    whole = rows(partition.grow_parts(grid, 8))
    pdf = grid.toPandas()
    degree = pdf[["u", "v"]].stack().value_counts()
    own = partition._grow(pdf.assign(n_u=degree[pdf["u"]].to_numpy(), n_v=degree[pdf["v"]].to_numpy()), 8, 1)
    assert whole == sorted(own.itertuples(index=False, name=None))
