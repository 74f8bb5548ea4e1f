"""Importance resampling against dictionaries, one text at a time."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarmac.llm import importance

SCHEMA = "doc_id long, text string, grp int, AT long, part string, docs string, Weight int"


def expected(docs, target, low=1, high=1, buckets=10_000, seed=2024, percent=10, least=20):
    def grams(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return len(words), [b" ".join(words[k : k + n]) for n in range(low, high + 1) for k in range(len(words) - n + 1)]

    bucket = lambda g: zlib.crc32(g) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        n, found = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["The", "É", "naïve", "x" * 90, "10%", "don't"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(n)]
    rows += [(5, rows[3][1])] * 25 + [(None, rows[4][1]), (None, None), (10**15, ""), (-4, "the " * 40)]
    return rows, [" ".join(rng.choices(words[:40], k=30)) for _ in range(9)] + [None, ""]


def frames(spark, docs, target):
    df = spark.createDataFrame([(*d, 1, 2, "p", "d", 3) for d in docs], SCHEMA)
    return df, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")


@pytest.mark.parametrize("low,high,buckets", [(1, 1, 10_000), (1, 2, 97), (2, 3, 1000), (1, 1, 1)])
def test_scores_and_ranks(spark, low, high, buckets):
    docs, target = corpus(300)
    df, wanted = frames(spark, docs, target)
    got = importance.resample(df.repartition(5), wanted, percent=20, low=low, high=high, buckets=buckets)
    assert Counter(map(tuple, got.collect())) == expected(docs, target, low, high, buckets, percent=20)


def test_small_blocks_and_parts_of_long_texts(spark, monkeypatch):
    docs, target = corpus(60)
    docs.append((77, "ab É cd, the " * 3000))
    df, wanted = frames(spark, docs, target)
    want = expected(docs, target, 1, 2)
    small = importance._postings

    def tiny(*options):
        run = small(*options)

        def inside(batches):
            importance.ROWS, importance.BYTES, importance.PART = 7, 900, 50
            yield from run(batches)

        return inside

    monkeypatch.setattr(importance, "_postings", tiny)
    assert Counter(map(tuple, importance.resample(df.repartition(3), wanted, low=1, high=2).collect())) == want


def test_nothing_and_no_target(spark):
    docs, target = corpus(40)
    df, wanted = frames(spark, docs, target)
    assert importance.resample(df.limit(0), wanted).count() == 0
    assert Counter(map(tuple, importance.resample(df, wanted.limit(0)).collect())) == expected(docs, [])


def test_a_word_in_all_documents_is_no_hot_key(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the "), F.col("id").cast("string")).alias("text")).repartition(6)
    run = importance.Resampling(df, df.limit(10))
    blocks = run.postings.where("grp >= 0").groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.octet_length("docs")).alias("bytes")).collect()
    assert len(blocks) == importance.GROUPS
    assert max(b.n for b in blocks) <= 2 * min(b.n for b in blocks)  # rows by group follow runs of documents, not words


@pytest.mark.parametrize("bad", [{"low": 0}, {"low": 2, "high": 1}, {"buckets": 0}])
def test_options_are_checked(spark, bad):
    df, wanted = frames(spark, *corpus(9))
    with pytest.raises(ValueError):
        importance.resample(df, wanted, **bad)
