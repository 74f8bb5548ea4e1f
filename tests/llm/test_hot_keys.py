"""Passages that many documents share, equal rows, many sources, colliding digests, and stop rules."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarmac.llm import exact_dedup, minhash, packing, quality, sharding, suffix_dedup, toxicity


def template_corpus(n, own, seed=1):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(90))
    word = lambda: f"w{rng.randrange(10**7)}"
    return [(k, " ".join([*(word() for _ in range(own // 2)), passage, *(word() for _ in range(own // 2))])) for k in range(n)]


def candidates(spark, rows):
    """Pairs that are compared as pairs of classes without a common hub, and the rows posted for them."""
    engine, counts = minhash.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), {}
    confirm, table = engine.confirm, engine.space.table

    def counted(df, label):
        out = table(df, label)
        if label in ("posted", "signatures"):
            counts[label] = out.count()
        return out

    engine.space.table = counted
    engine.confirm = lambda pairs, label: confirm(pairs, label)
    comps = engine.solve()
    return counts, comps


def test_candidates_of_a_shared_passage_do_not_grow_with_the_square(spark):
    few, _ = candidates(spark, template_corpus(250, 60))
    many, comps = candidates(spark, template_corpus(1000, 60))
    for label in ("posted", "signatures"):
        assert many[label] <= 4 * max(few[label], 25) * math.log2(8)
    assert comps.count() == comps.select("comp").distinct().count()


def test_links_across_groups_of_a_shared_passage_are_found(spark):
    rng = random.Random(4)
    rows = template_corpus(120, 44, seed=3)  # no two linked: 0.5 of each is the passage
    for k in range(30):
        words = rows[k][1].split()
        for _ in range(3):
            words[rng.choice([*range(22), *range(112, 134)])] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    low[a] = low[b] = min(low[a], low[b])
    assert got == low and len(set(low.values())) < len(rows)


def test_bytes_are_compared_in_the_call_that_brings_a_hit(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "text_digest", lambda text: F.substring(F.sha2(exact_dedup.normalised(text).cast("binary"), 256), 1, 1))
    first, second = [(1, "a b"), (2, "ab"), (3, "q"), (4, None)], [(5, "a  b"), (6, "zz"), (7, "q "), (8, "\t"), *[(10 + k, f"text {k}") for k in range(30)], (60, "text  3")]
    schema = "doc_id long, text string"
    engine = exact_dedup.Deduplicator(spark, files_per_batch=1)
    engine.ingest(spark.createDataFrame(first, schema))
    before = engine._exists(engine.doubt) and engine.doubtful().count()
    engine.ingest(spark.createDataFrame(second, schema).repartition(2))
    assert engine.doubtful().count() > (before or 0)
    groups: dict[str, list] = {}
    for i, t in first + second:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    expected = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in engine.result().collect()} == expected


def test_rounds_stop_where_nothing_occurs_again(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    real, lengths = suffix_dedup.doubled, []
    monkeypatch.setattr(suffix_dedup, "doubled", lambda ranks, length: lengths.append(length) or real(ranks, length))
    for shared, rounds in ((80, []), (320, [96])):
        lengths.clear()
        same = word(shared)
        texts = [word(300) + same + word(300) for _ in range(40)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.RepeatedPassages(df).result().collect()}
        assert got == {k: (sum(b - a for a, b in s), len(s)) for k, s in enumerate(suffix_dedup.brute_force([t.encode() for t in texts]))}
        assert lengths == rounds


def test_ranks_are_places_in_sorted_order(spark):
    space = suffix_dedup.Workspace(spark, "ranks")
    rows = [(k, 0, True, a, b) for k, (a, b) in enumerate([(5, -1), (5, -1), (2, 9), (2, 9), (7, 7), (-3, 4), (-3, 4)])]
    df = space.table(spark.createDataFrame(rows, "context long, c int, open boolean, r1 long, r2 long"), "pairs")
    assert sorted((r.context, r["rank"]) for r in suffix_dedup.rerank(df, space).collect()) == [(0, 2), (1, 2), (2, 1), (3, 1), (5, 0), (6, 0)]


def test_rows_that_are_alike_are_dealt_to_many_tasks(spark):
    equal = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit("s").alias("source"))
    single = spark.range(20_000).select("id", F.lit("t").alias("text"), F.col("id").cast("string").alias("source")).withColumnRenamed("id", "doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (equal, single):
        got = sharding.interleave(df, 16)
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2 * 20_000 / parts
        slots = Counter((r.shard, r.slot) for r in got.collect())
        assert max(slots.values()) == 1 and Counter(s for s, _ in slots) == Counter({s: 1250 for s in range(16)})


def test_equal_pieces_are_packed_each(spark):
    import public_tokenizers

    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text")).repartition(4)
    got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    places = Counter((r.sequence_id, r.offset) for r in got)
    assert len(got) == 3000 and max(places.values()) == 1
    ends = Counter()
    for r in got:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 64 and sum(e < 64 - got[0].length for e in ends.values()) <= 1


def test_an_independent_quality_scorer():
    """The whole network by loops in plain Python: marks, filters, steps, chunks, pooling."""
    net, rng = quality.Network(5), random.Random(3)
    taps, mix = net.taps.tolist(), net.mix.tolist()
    for text in [b"", b"a", b"short text", bytes(rng.randrange(32, 127) for _ in range(130)), ("w\u00f6rter und mehr, " * 9).encode()]:
        data = (text or b"\n") + b"\n" * (quality.WIDTH - 1)
        marked = [any(i - 3 - lag >= 0 and data[i - 3 : i + 1] == data[i - 3 - lag : i + 1 - lag] for lag in quality.LAGS) for i in range(len(data))]
        symbols = [b + 256 * m for b, m in zip(data, marked)]
        n = len(symbols) - quality.WIDTH + 1
        out = [[max(0.0, sum(taps[k][symbols[p + k]][f] for k in range(quality.WIDTH)) + float(net.first[f])) for f in range(quality.FILTERS)] for p in range(n)]
        steps = [out[at : at + quality.STEP] for at in range(0, n, quality.STEP)]
        chunks = [a + b for a, b in zip(steps, steps[1:])] or steps
        best = [0.0] * quality.HIDDEN
        for chunk in chunks:
            mean = [sum(row[f] for row in chunk) / len(chunk) for f in range(quality.FILTERS)]
            best = [max(b, sum(mean[f] * mix[f][h] for f in range(quality.FILTERS)) + float(net.second[h])) for h, b in enumerate(best)]
        z = sum(b * float(w) for b, w in zip(best, net.out)) + float(net.bias[0])
        assert abs(net.probability(text) - 1 / (1 + math.exp(-z))) < 1e-4


def test_training_and_scoring_share_their_windows():
    text = "road road road idiot " * 9 + "stone field " * 8
    words = toxicity.tokens(text)
    mask = toxicity.again(words)
    assert len(mask) == len(words) and mask.sum() == 18
    model = toxicity.fit([text.encode(), b"calm river stone"] * 3, np.array([1.0, 0.0] * 3), epochs=2)
    margins = np.array([0.0 if m else next(iter(model._margins([w]))) for w, m in zip(words, mask)])
    assert abs(next(iter(model.score([text]))) - 1 / (1 + math.exp(-(model.bias + toxicity.worst(margins)[0])))) < 1e-9
