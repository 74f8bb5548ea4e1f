"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Features are runs of words, hashed into buckets. One pass over the texts writes, for each run of documents and group of buckets, a block
of postings (document, bucket, count), combined by document before they are shuffled; and each task's totals by bucket. Blocks are shuffled by
(group of buckets, part of the corpus), where they meet the totals of that group from both corpora. There each bucket's gain is
computed, each posting becomes count * gain, and a document's sum over the group is emitted. A last shuffle adds these up by document.

Every run of documents has a block in every group, so a word that is in all documents makes blocks longer by one posting a document and no key hot.
Groups are split into as many parts as the cluster's shuffle partitions ask for, so more data means more tasks and not longer ones. What a
task holds is one batch and the totals of its group, ``buckets / GROUPS`` rows.

A document's score is its weight (the sum of gains over its features) and Gumbel noise from a hash of its id, and the highest scores are drawn, in
the order of scores, ties to the smaller id.

Defined results: null text has no features; documents without features weigh 0; a null id counts as empty text in the hash and
loses ties; repeated rows count each, with equal scores and ranks of their own; an empty corpus or target adds nothing to the totals;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import numbered
from .common import Workspace, text_of, tidied

#: Letters a-z, digits and all beyond ASCII, in lower-cased UTF-8.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GROUPS = 16
#: A block covers at most so many documents, and about so many bytes of text.
ROWS, BYTES = 2000, 4_000_000
#: A long text is read in parts of about so many bytes that end between words.
PART = 1 << 20
#: Kinds of rows of the postings table besides groups of buckets.
DOCUMENT, TOTAL = -1, -2
SCHEMA = "grp int, at long, doc_id string, n_words long, n_features long, docs binary, buckets binary, counts binary"


class BucketOf(dict):
    """Word -> bucket, remembered for words that are not long; emptied when it is full."""

    def __init__(self, buckets: int, most: int = 200_000) -> None:
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) % self.buckets
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lower case, part by part."""
    text, at = text.lower(), 0
    while at < len(text):
        end = at + PART
        while end < len(text) and WORD.match(text, end - 1, end) and WORD.match(text, end, end + 1):
            end += 1
        yield WORD.findall(text, at, end)
        at = end


def features(text: bytes, low: int, high: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, runs of ``low`` to ``high`` consecutive words) of a text, part by part."""
    before: list[bytes] = []
    for part in words(text):
        if high == 1:
            yield len(part), part
            continue
        run = before + part
        # A run counts in the part where it ends.
        yield len(part), [b" ".join(run[k : k + n]) for n in range(low, high + 1) for k in range(max(0, len(before) - n + 1), len(run) - n + 1)]
        before = run[-(high - 1) :]


def _postings(buckets: int, low: int, high: int, post: bool):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                ids.append(doc_id.as_py())
                texts.append(text)
                size += len(text)
                if len(ids) >= ROWS or size >= BYTES:
                    yield ids, texts
                    ids, texts, size = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.int32()), ("at", pa.int64()), ("doc_id", pa.string()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("docs", pa.binary()), ("buckets", pa.binary()), ("counts", pa.binary())])

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        first = TaskContext.get().partitionId() << 40
        total, bucket_of = np.zeros(buckets, dtype=np.int64), BucketOf(buckets)
        for ids, texts in blocks(batches):
            n_words, n_features, found = [], [], []
            for k, text in enumerate(texts):
                held, seen = [0, 0], np.zeros(0, dtype=np.int64)
                for n, part in features(text, low, high):
                    held[0] += n
                    held[1] += len(part)
                    seen = np.concatenate((seen, np.fromiter(map(bucket_of.__getitem__, part), dtype=np.int64, count=len(part))))
                    if len(seen) > PART:
                        total += np.bincount(seen, minlength=buckets)
                        found.append((k, *np.unique(seen, return_counts=True)))
                        seen = seen[:0]
                total += np.bincount(seen, minlength=buckets)
                found.append((k, *np.unique(seen, return_counts=True)))
                n_words.append(held[0])
                n_features.append(held[1])
            if not post:
                continue
            yield rows(len(ids), grp=np.full(len(ids), DOCUMENT), at=first + np.arange(len(ids)), doc_id=ids, n_words=n_words, n_features=n_features)
            doc = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int32)
            bucket = np.concatenate([f[1] for f in found])
            count = np.concatenate([f[2] for f in found])
            order = np.argsort(bucket % GROUPS, kind="stable")
            ends = np.searchsorted((bucket % GROUPS)[order], np.arange(GROUPS + 1))
            cut = [order[a:b] for a, b in zip(ends[:-1], ends[1:])]
            some = [g for g in range(GROUPS) if len(cut[g])]
            if some:
                yield rows(
                    len(some), grp=some, at=[first] * len(some), docs=[doc[cut[g]].tobytes() for g in some],
                    buckets=[(bucket[cut[g]] // GROUPS).astype(np.int32).tobytes() for g in some], counts=[count[cut[g]].astype(np.int32).tobytes() for g in some],
                )
            first += len(ids)
        seen = np.flatnonzero(total)
        yield rows(len(seen), grp=np.full(len(seen), TOTAL), at=seen, n_features=total[seen])

    return tidied(run)


def gain(t: int, s: int, all_t: int, all_s: int, buckets: int) -> int:
    """A thousand times the logarithm of how much likelier a bucket is in the target, smoothed by one for each bucket, rounded down."""
    return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))


def _contributions(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, gains = None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                grp, at, docs, bucket, count, totals, all_s, all_t = (c[row] for c in batch.columns)
                if kept != (grp := grp.as_py()):
                    kept, gains = grp, np.zeros(-(-buckets // GROUPS), dtype=np.int64)
                    for own in totals.as_py():
                        gains[own["bucket"] // GROUPS] = gain(own["t"], own["s"], all_t.as_py(), all_s.as_py(), buckets)
                docs, bucket, count = (np.frombuffer(c.as_buffer(), dtype=np.int32) for c in (docs, bucket, count))
                found = docs - docs[0]  # rising, so the first is the smallest
                parts = np.zeros(int(found[-1]) + 1, dtype=np.int64)
                np.add.at(parts, found, count.astype(np.int64) * gains[bucket])
                seen = np.unique(found)
                yield pa.RecordBatch.from_arrays([pa.array(at.as_py() + int(docs[0]) + seen.astype(np.int64)), pa.array(parts[seen])], ["at", "part"])

    return tidied(run)


def noise(seed: int, id_col: str = "doc_id") -> Column:
    """Gumbel noise from a hash of the id, in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


class Resampling:
    def __init__(
        self, docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024,
        id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    ) -> None:
        if not 1 <= low <= high or buckets < 1:
            raise ValueError("runs have at least one word, and there is at least one bucket")
        self.buckets, self.seed = buckets, seed
        self.space = Workspace(docs.sparkSession, "importance")
        self.kind = docs.schema[id_col].dataType
        rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
        self.postings = self.space.table(rows.mapInArrow(_postings(buckets, low, high, True), SCHEMA), "postings")
        wanted = target.select(F.lit(None).cast("string").alias("doc_id"), text_of(target_col).cast("binary").alias("text"))
        wanted = wanted.mapInArrow(_postings(buckets, low, high, False), SCHEMA).where(F.col("grp") == TOTAL).select("at", F.lit(0).alias("s"), F.col("n_features").alias("t"))
        own = self.postings.where(F.col("grp") == TOTAL).select("at", F.col("n_features").alias("s"), F.lit(0).alias("t"))
        totals = own.unionByName(wanted).groupBy(F.col("at").alias("bucket")).agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        self.totals = self.space.table(totals, "totals")

    def weights(self) -> DataFrame:
        """(at, doc_id, n_words, n_features, weight): one row per document."""
        whole = self.totals.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
        parts = -(-4 * int(self.space.spark.conf.get("spark.sql.shuffle.partitions")) // GROUPS)
        grp = F.pmod("bucket", F.lit(GROUPS)).cast("int").alias("grp")
        cogroup = self.totals.groupBy(grp).agg(F.collect_list(F.struct("bucket", "s", "t")).alias("totals"))  # buckets / GROUPS of them
        cogroup = cogroup.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        blocks = self.postings.where("grp >= 0").select("grp", "at", "docs", "buckets", "counts", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int").alias("part"))
        met = blocks.join(cogroup.hint("shuffle_hash"), ["grp", "part"]).select("grp", "at", "docs", "buckets", "counts", "totals", F.lit(whole.s or 0).cast("long").alias("all_s"), F.lit(whole.t or 0).cast("long").alias("all_t"))
        gained = met.mapInArrow(_contributions(self.buckets), "at long, part long")
        documents = self.postings.where(F.col("grp") == DOCUMENT).select("at", "doc_id", "n_words", "n_features", F.lit(0).cast("long").alias("part"))
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "string"), ("n_words", "long"), ("n_features", "long"))]
        rows = documents.unionByName(gained.select("at", *empty, "part"))
        summed = rows.groupBy("at").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("part").alias("weight"))
        return summed.withColumn("doc_id", F.col("doc_id").cast(self.kind))

    def draw(self, percent: int = 10, least_words: int = 20) -> DataFrame:
        """One row per document: doc_id, n_features, weight, score, rank (from 1 among those drawn, else null).

        Of the N documents with at least ``least_words`` words, floor(percent * N / 100) are drawn.
        """
        scored = self.space.table(self.weights().withColumn("score", F.col("weight") + noise(self.seed)), "scores")
        able = F.col("n_words") >= least_words
        drawn = percent * scored.where(able).count() // 100
        ranked = numbered(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at")], "place", self.space)
        rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
        out = ["doc_id", "n_features", "weight", "score"]
        return ranked.select(*out, rank).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, **options) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank."""
    return Resampling(docs, target, **options).draw(percent, least_words)
