"""Recall and reading of the nearest-neighbour index, measured against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tarmac.llm import ann, queries

FOLDER = "/root/testdata/sf0.1"


def test_registered_query_reaches_its_recall_on_the_whole_table(spark):
    table = queries.table(spark, FOLDER, "embeddings")
    got, truth = queries.op6_nearest_neighbours(spark, FOLDER).toPandas(), ann.exact(table, 100, 10)
    assert ann.recall(got, truth) >= 0.9
    assert len(got) == len(truth) and (got.groupby("query_id")["rank"].apply(sorted).map(tuple) == tuple(range(1, 11))).all()
    both = got.merge(truth, on=["query_id", "vec_id"], suffixes=("", "_true"))
    assert np.allclose(both["score"], both["score_true"], rtol=1e-12)


def clustered(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (n // 60, 24))
    return middles[rng.integers(0, len(middles), n)] + rng.normal(0, 0.25, (n, 24))


@pytest.mark.parametrize("n", [6_000, 24_000])
def test_clustered_vectors_need_few_lists(n):
    vectors = clustered(n, 3)
    lists = n // ann.TARGET
    index = ann.Index(vectors[: lists * ann.LEAF], vectors[lists * ann.LEAF :][: ann.APART], lists, 10, n)
    asked = vectors[-200:]
    share, posted = ann.share_read(index, vectors, asked)
    members = [set() for _ in index.graph.points]
    for k, row in enumerate(index.post(vectors)):
        for c in row:
            members[c].add(k)
    hit = 0
    for q, row in zip(range(n - 200, n), index.probe(asked)):
        d = ((vectors - vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set().union(*(members[c] for c in row)) & set(np.argpartition(d, 10)[:10].tolist()))
    assert hit / 2000 >= 0.9 and share < 0.2 and posted < 2


def test_exact_mode_reads_everything(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (1200, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, truth = ann.nearest(df, exactly=True).toPandas(), ann.exact(df, 100, 10)
    assert ann.recall(got, truth) == 1.0


def test_many_queries_of_one_list_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "PART_ROWS", 32)
    rng = np.random.default_rng(6)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (300, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, truth = ann.nearest(df, every=3, exactly=True).toPandas(), ann.exact(df, 3, 10)
    assert ann.recall(got, truth) == 1.0 and len(got) == len(truth)


def test_rows_unlike_most_find_their_nearest_too(spark):
    # Tight clusters set the ratio; rows without structure, all that are asked for among them, need far more lists.
    rng = np.random.default_rng(9)
    vectors = rng.normal(0, 1, (40, 24))[rng.integers(0, 40, 6_000)] + rng.normal(0, 0.01, (6_000, 24))
    vectors[::10] = rng.normal(0, 1, (600, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got, truth = ann.nearest(df).toPandas(), ann.exact(df, 100, 10)
    assert ann.recall(got, truth) == 1.0 and len(got) == len(truth)
    assert (got.sort_values(["query_id", "rank"])["vec_id"].to_numpy() == truth.sort_values(["query_id", "rank"])["vec_id"].to_numpy()).all()
