"""Operators read the whole of each text."""

from __future__ import annotations

import random

import numpy as np

from tarmac.llm import minhash, toxicity


def test_toxicity_scores_every_part_of_a_long_run():
    margin = np.zeros(toxicity.BUCKETS)
    margin[[g for g in toxicity.grams("idiot")]] = 8.0
    model = toxicity.Model(margin, -1.0)
    for joint in ("_", "/", ".", "字"):
        clean = joint.join(["walk"] * 60)
        calm = next(model.score([clean]))
        for at in (0, 63, 64, 65, 150, len(clean) // 2, len(clean)):
            assert next(model.score([clean[:at] + joint + "idiot" + joint + clean[at:]])) > calm, (joint, at)


def test_toxicity_repeats_of_a_long_run_add_nothing():
    margin = np.random.default_rng(3).normal(1, 1, toxicity.BUCKETS)
    model = toxicity.Model(margin, 0.0)
    run = "_".join(f"word{k}" for k in range(12))
    once, twice = model.score([run, f"{run} {run}"])
    assert twice <= once + 1e-12


def test_near_copies_that_agree_on_few_coordinates_are_linked(spark):
    rng = random.Random(11)
    found = []
    while len(found) < 2:
        words = [f"w{rng.randrange(10**9)}" for _ in range(12)]
        whole, part = " ".join(words), " ".join(words[:10])  # 8 and 6 shingles: similarity 0.75
        a, b = map(minhash.signature, minhash.shingle_sets([whole.encode(), part.encode()]))
        if 30 <= (a == b).sum() < 34:
            found.append((whole, part))
    rows = [(2 * k + side, text) for k, pair in enumerate(found) for side, text in enumerate(pair)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got["component_id"].to_dict() == {0: 0, 1: 0, 2: 2, 3: 2}
