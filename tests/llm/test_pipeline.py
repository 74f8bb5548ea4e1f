"""The pipeline's stages, and all of them by ``run``, against brute force."""

from __future__ import annotations

import random

import corpus_pipeline
from tarmac.llm import suffix_dedup


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("road town field river stone cloud".split()) + str(rng.randrange(500)) for _ in range(n))
    passage = words(45)
    texts = [words(60) for _ in range(12)] + [f"{words(30)} {passage} {words(30)}" for _ in range(2)]
    near = texts[1].split()
    near[30] = "edit"
    texts += [texts[0], texts[0].replace(" ", "  "), " ".join(near)]
    docs = spark.createDataFrame([(k, t, "en", "test", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    best = {}
    for k, t in enumerate(texts):
        key = "".join(t.split())
        if key not in best or len(t) > len(texts[best[key]]):
            best[key] = k
    exact = sorted(best.values())
    kept = []  # the near copies here are pairs
    for k in exact:
        a = shingles(texts[k])
        if not any(100 * len(a & shingles(texts[o])) >= 75 * len(a | shingles(texts[o])) for o in kept):
            kept.append(k)
    cut = suffix_dedup.brute_force([texts[k].encode() for k in kept])
    left = {k: suffix_dedup.without(texts[k].encode(), s).decode() for k, s in zip(kept, cut)}
    assert len(texts) > len(exact) > len(kept) and sum(map(len, cut)) >= 2

    stages = dict(corpus_pipeline.STAGES)
    folder = str(tmp_path)
    one = stages["exact dedup"](spark, docs, folder).cache()
    assert sorted(r.doc_id for r in one.collect()) == exact
    two = stages["near dedup"](spark, one, folder).cache()
    assert sorted(r.doc_id for r in two.collect()) == kept
    three = stages["repeated passages"](spark, two, folder).cache()
    assert {r.doc_id: (r.text, r.n_chars) for r in three.collect()} == {k: (t, len(t)) for k, t in left.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == set(left)
