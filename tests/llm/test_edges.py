"""Ids at the ends of their range beside nulls, clashing names, repeated rows and empty tables, for every operator."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarmac.llm import ann, chat_template, common, exact_dedup, minhash, packing, quality, queries, sentencepiece_codec, sharding, suffix_dedup, toxicity

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
BIG, LEAST = 2**53 + 1, -(2**63)
#: Names that operators use or used inside, in any case.
OTHERS = ("_At", "_KEY", "_spans", "bytes", "H", "list", "Own_0", "OWN_1", "kept", "Token", "held_out", "locator")
NET = quality.Network(1)
MODEL = toxicity.Model(np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS), -1.0)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(90))
    texts = [(BIG, long), (LEAST, long), (None, long + " "), (None, None), (7, "a b"), (7, "a b"), (BIG - 1, ""), (8, "other " + long[:300]), (2**63 - 1, "é" * 300)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OTHERS)
    return spark.createDataFrame([(i, t, None, None, None, *(f"{c}{k}" for c in OTHERS)) for k, (i, t) in enumerate(texts)], schema).repartition(3).cache()


def ids(rows, column="doc_id"):
    return Counter(r[column] for r in rows.select(column).collect())


@pytest.mark.parametrize("run", [
    lambda d: quality.score(d, NET), lambda d: toxicity.score(d, MODEL), exact_dedup.deduplicate, minhash.near_duplicates, lambda d: suffix_dedup.RepeatedPassages(d).result(),
    lambda d: packing.pack(d, WORD_BPE), sharding.interleave, lambda d: sentencepiece_codec.encode(d, PIECE_BPE), lambda d: sentencepiece_codec.encode_ids(d, PIECE_BPE),
], ids=["quality", "toxicity", "exact", "near", "passages", "packing", "sharding", "pieces", "piece_ids"])
def test_every_row_comes_out_with_its_id(docs, run):
    assert ids(run(docs)) == ids(docs)
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("run", [
    lambda d: quality.score(d, NET, threshold=0.0, keep=True), exact_dedup.keep, minhash.keep, lambda d: suffix_dedup.RepeatedPassages(d).keep(),
], ids=["quality", "exact", "near", "passages"])
def test_kept_rows_have_their_own_columns(docs, run):
    kept = run(docs)
    assert kept.columns == docs.columns and run(docs.limit(0)).count() == 0
    whole = {tuple(r[c] for c in OTHERS): r.doc_id for r in docs.collect()}
    rows = kept.collect()
    assert rows and all(whole[tuple(r[c] for c in OTHERS)] == r.doc_id for r in rows)


def test_the_smallest_id_stays(docs):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.deduplicate(docs.where("length(text) > 300 and source is null and (doc_id is null or doc_id <> 8)")).collect()}
    assert got == {(BIG, None, 3), (LEAST, None, 3), (None, None, 3)}  # the longest text stays, and it has no id
    got = {(r.doc_id, r.keep_id) for r in exact_dedup.deduplicate(docs.where(F.col("doc_id").isin(BIG, LEAST))).collect()}
    assert got == {(BIG, LEAST), (LEAST, LEAST)}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs.where(F.col("doc_id").isin(BIG, LEAST))).collect()}
    assert got == {BIG: LEAST, LEAST: LEAST}


def test_chats_keep_their_ids(spark):
    rows = [(BIG, 0, "user", "a"), (None, 0, "user", "b"), (LEAST, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert ids(chat_template.read_back(chat_template.format_chats(df)), "conv_id") == Counter([BIG, None, LEAST])


def test_vectors_keep_their_ids(spark):
    rows = [(100 * (BIG // 100), [1.0, 0.0]), (BIG, [1.0, 0.1]), (None, [1.0, 0.2]), (LEAST, [0.0, 1.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("H", F.lit(1)).withColumn("list", F.lit(2))
    assert [(r.query_id, r.vec_id) for r in ann.nearest(df).orderBy("rank").collect()] == [(100 * (BIG // 100), BIG), (100 * (BIG // 100), LEAST)]


def test_a_repeated_id_is_sampled_once_and_whole(spark):
    text = "x" * 9000 + " end"
    df = spark.createDataFrame([(1, text)] * 50 + [(1, text + "."), (2, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)] * 9, "doc_id long, quality int")
    texts, y = common.labelled_sample(df, labels, "quality", 10, 1 << 20)
    assert texts == [text.encode(), b"y"] and y.tolist() == [1.0, 1.0]
    assert common.labelled_sample(df, labels, "quality", 10, 2000)[0] == [b"y"]


def test_evidence_late_in_a_text_is_learned(spark):
    rng = random.Random(5)
    calm = lambda n: " ".join(rng.choice(["road", "river", "stone", "cloud", "field"]) for _ in range(n))
    rows = [(k, calm(900) + (" you wretched zorgbat" if k % 2 else " you quiet person")) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    assert min(t.find(" you ") for _, t in rows) > 4096
    got = {r.doc_id: r.predicted for r in toxicity.score(df, toxicity.train(df, labels)).where("held_out").collect()}
    assert np.mean([p == k % 2 for k, p in got.items()]) > 0.9


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(3)
    net = quality.Network(3)
    for name in ("taps", "first", "mix", "second", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    symbols = net.symbols(b"A few words, some words, and 12 more words to read over several chunks of bytes.\n\n" * 3)
    ups = [np.zeros_like(w) for w in net.weights()]
    quality._backward(net, symbols, 1.0, 0.7, ups)

    def loss() -> float:
        total, count = net.halves(symbols)
        total, count = total[:-1] + total[1:], (count[:-1] + count[1:]).astype(float)[:, None]
        z = float(np.maximum((total / count) @ net.mix + net.second, 0).max(0) @ net.out + net.bias[0])
        return 0.7 * math.log1p(math.exp(-z))

    for w, up in zip(net.weights(), ups):
        for k in [*rng.integers(0, w.size, 12), *np.argsort(-np.abs(up).ravel())[:6]]:
            at, step = np.unravel_index(k, w.shape), 1e-6
            was = w[at]
            w[at] = was + step
            more = loss()
            w[at] = was - step
            less = loss()
            w[at] = was
            assert abs((more - less) / (2 * step) - up[at]) < 1e-4 * max(1, abs(up[at]))


def test_an_independent_toxicity_scorer():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["idiot", "road", "Road,", "id-iot", "...", "é", "a_b", "x" * 70, "road"]) for _ in range(rng.randrange(0, 60))) for _ in range(80)]
    for text, score in zip(texts, MODEL.score(texts)):
        words = toxicity.tokens(text)
        worth = [0.0 if k and w == words[k - 1] else (sum(MODEL.gram_margin[g] for g in toxicity.grams(w)) / max(1, len(toxicity.grams(w)))) for k, w in enumerate(words)]
        n, size, step = len(words), toxicity.WINDOW, toxicity.STEP
        starts = [0] if n <= size else [*range(0, n - size, step), n - size]
        best = max(sum(worth[s : s + size]) / size for s in starts)
        assert abs(score - 1 / (1 + math.exp(-(MODEL.bias + best)))) < 1e-9


def test_places_of_shards(docs):
    """Ranks and cuts by sorting everything."""
    shards, seed = 4, 7
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    stratum = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    more = docs.unionByName(docs.withColumn("source", F.lit("hot")).withColumn("doc_id", F.hash("text", "_At").cast("long")))
    rows = more.select("doc_id", crc.alias("crc"), stratum.alias("stratum"), F.xxhash64(F.lit(seed), "doc_id", crc).alias("shuffled"), F.xxhash64(F.lit(seed), stratum).alias("h")).collect()
    null_first = lambda i: (i is not None, i or 0)
    placed = []
    for s in {r.stratum for r in rows}:
        own = sorted((r for r in rows if r.stratum == s), key=lambda r: (r.shuffled, null_first(r.doc_id), r.crc))
        placed += [((k + 0.5) / len(own), r.h, r.shuffled, null_first(r.doc_id), r.crc, r.doc_id) for k, r in enumerate(own)]
    placed.sort()
    expected = []
    for place, row in enumerate(placed):
        shard = place * shards // len(placed)
        expected.append((row[5], row[4], shard, place - -(-shard * len(placed) // shards)))
    got = [(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.interleave(more, shards, seed).collect()]
    assert Counter(got) == Counter(expected)


def test_pieces_of_the_documents_table(spark):
    codec = sentencepiece_codec.Codec(PIECE_BPE)
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()}
    got = queries.op9_sentencepiece(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        pieces = codec.library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(pieces), hashlib.sha256(" ".join(map(str, pieces)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(pieces).encode()).hexdigest()


def test_the_pipeline_with_nulls_and_with_nothing(spark, docs, tmp_path):
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
    left = ids(now)
    assert ids(corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))) == left and sum(left.values()) == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
