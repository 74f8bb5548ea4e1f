"""Mixing against seats handed out one by one and streams laid out word by word."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarmac.llm import mixing

SCHEMA = "doc_id long, text string, source string, Size long, TARGET string, bucket int, copies int"


def rows_of(spec, seed=1):
    rng, out = random.Random(seed), []
    for source, sizes in spec.items():
        for n in sizes:
            out.append((len(out), " \t".join(rng.choice(["a", "bé", "c\x00d"]) for _ in range(n)) + "\n", source, 0, "x", 1, 2))
    return out


def expected(rows, shards, block=None, weights=(1, 2, 3), most=3, seed=7):
    docs = []
    for doc_id, text, source, *_ in rows:
        key = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        docs.append((doc_id, source, len((text or "").split()), int(key[:15], 16)))
    size = Counter()
    for _, source, n, _ in docs:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    block = block or max(1, min(64, total // 1024))
    while True:
        left = total - sum(most * size[s] for s in capped)
        share = {s: weight[s] * left / max(1, sum(weight[x] for x in order if x not in capped)) for s in order}
        more = {s for s in order if share[s] > most * size[s]}
        if more <= capped:
            break
        capped |= more
    target = {s: min(share[s], float(most * size[s])) for s in order}
    quota, given, ends = Counter(), Counter(), []
    house = (2 * total + block) // (2 * block)
    for j in range(1, shards + 1):
        while sum(given.values()) < house * j // shards:
            given[max(order, key=lambda s: (target[s] / (given[s] + 0.5), -order.index(s)))] += 1
        ends.append(dict(given))
    for s in order:
        quota[s] = min(given[s], most * size[s] // block)
    stream, taken = defaultdict(list), []
    for doc in sorted(docs, key=lambda d: (d[3], d[0] is not None, d[0] or 0, d[2])):
        stream[doc[1]] += [id(doc)] * doc[2]
    words = Counter()
    for s, run in stream.items():
        words.update(run[k % len(run)] for k in range(quota[s] * block))
    for doc in docs:
        taken.append((doc[0], doc[2], size[doc[1]], target[doc[1]], words[id(doc)]))
    return taken, {s: [min(e.get(s, 0), most * size[s] // block) for e in ends] for s in order}, block


SPECS = {
    "even": {"b": [5, 9, 30, 0, 1], "a": [12] * 9, "ab": [3, 700], None: [40, 40]},
    "capped": {"x": [4], "y": [3, 3], "z": [900, 5, 5], "é": [2], "\U0001f600": [60]},
    "hot": {"a": [random.Random(4).randrange(40) for _ in range(700)], "b": [8] * 200, "c": [1]},
    "alone": {None: [3, 0, 9]},
    "no words": {"a": [0, 0], None: [0]},
}


@pytest.mark.parametrize("name", SPECS)
@pytest.mark.parametrize("block", [None, 4])
def test_taken_words_by_hand(spark, name, block):
    rows = rows_of(SPECS[name])
    mix = mixing.Mixture(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=5, block=block)
    want, ends, size = expected(rows, 5, block)
    got = [tuple(r) for r in mix.documents().select("doc_id", "size", "source_size", "target", "taken").collect()]
    key = lambda r: (r[0], r[1], r[4])
    assert mix.block == size and len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:3] == w[:3] and g[4] == w[4] and abs(g[3] - w[3]) < 1e-6
    given = {r.stratum: r.ends for r in mix.quotas.collect()}
    assert given == {f"s{s}" if s is not None else "t": e for s, e in ends.items() if any(w[3] for w in want if w[2] and s is not None) or s in ends and sum(SPECS[name][s])}


@pytest.mark.parametrize("name", ["even", "capped", "hot"])
def test_pieces_fill_the_shards(spark, name):
    rows = rows_of(SPECS[name])
    mix = mixing.Mixture(spark.createDataFrame(rows, SCHEMA), shards=4, block=3)
    pieces = mix.pieces().collect()
    docs = {r.doc_id: r for r in mix.documents().collect()}
    words = Counter()
    for p in pieces:
        assert 0 <= p["first"] and p["first"] + p.words <= docs[p.doc_id]["size"] and 0 < p.words <= 3 and 0 <= p.shard < 4
        words[p.doc_id] += p.words
    assert words == Counter({i: d.taken for i, d in docs.items() if d.taken})
    _, ends, _ = expected(rows, 4, 3)
    source, per = {r[0]: r[2] for r in rows}, defaultdict(set)
    for p in pieces:
        per[source[p.doc_id], p.shard].add(p.block)
    for s, e in ends.items():
        assert [len(per[s, j]) for j in range(4)] == [b - a for a, b in zip([0, *e], e)]
    shuffled = [p.shard for p in sorted((p for p in pieces if source[p.doc_id] == max(ends, key=lambda s: ends[s][-1])), key=lambda p: p.block)]
    assert shuffled != sorted(shuffled)


def test_repeated_rows_nulls_and_reruns(spark):
    rows = [(None, None, None, 0, "", 0, 0)] * 30 + [(None, "a b c", "s", 0, "", 0, 0)] * 600 + [(None, "", "s", 0, "", 0, 0)] * 10 + rows_of({"q": [50, 60], "r": [5] * 40})
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = (Counter(map(tuple, mixing.mix(d).collect())) for d in (df, df.repartition(7)))
    want, _, _ = expected(rows, 16)
    assert one == two and sum(one.values()) == len(rows)
    assert Counter((r[0], r[1], r[4]) for r in one.elements()) == Counter((w[0], w[1], w[4]) for w in want)
    assert mixing.mix(df.limit(0)).count() == 0
    assert df.groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0] == 600
    assert mixing.Mixture(df).rows.count() < 60  # equal rows are one row on their way


@pytest.mark.parametrize("bad", [{"shards": 0}, {"most": 0}, {"weights": ()}, {"weights": (1, 0)}, {"block": 0}])
def test_options_are_checked(spark, bad):
    with pytest.raises(ValueError):
        mixing.Mixture(spark.createDataFrame(rows_of({"a": [1]}), SCHEMA), **bad)
