"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Sizes are words. Sources in order of name (null last) weigh 1, 2, 3, repeating, and share all words of the corpus by weight; a
source's target stops at ``most`` times its size, and what is above is shared again by weight until no target is above.

The mix is made of blocks of equally many words. Block k of a source (from 1) has the quotient target / (k - 1/2), and blocks go to the highest
quotients. Shard j of n ends with block M * j // n of all M in that order, which gives each source an integer quota for each
shard, and every shard the mixture of the whole to within a block or so of each source. Of M blocks only those can be in doubt that lie
within half the number of sources of the end, since rounding each source's share changes the total by no more; so a few
quotients a source and shard are ranked, whatever the size of the corpus.

A source's documents, in a seeded order, are a stream that begins again after its last word. Its quota of q blocks is the first q * block words
of it, and a seeded permutation says which of these blocks goes to which shard. A quota is at most ``most`` streams, so no document is taken
more than ``most`` times; a block that would be beyond is left out. Each source's taken words are within a block of its target.

Rows in the stream are numbered in two steps: equal rows are counted first, and rows fall into order-preserving buckets by their seeded
key, so that no window spans a source, though it may hold a third of all rows or rows that are all alike.

Defined results: null text has no words; a null source is a source of its own, after the others; null ids and
repeated rows are ordinary rows, each with its own place; empty documents and sources take nothing; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import numbered
from .common import Workspace, text_of

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 512
MOST_BUCKETS = 1 << 16
#: A block has so many words, or fewer in a corpus of fewer than ``LEAST_BLOCKS`` such blocks.
BLOCK = 64
LEAST_BLOCKS = 1024
#: Steps of the permutation of blocks: primes, of which one does not divide the quota.
STEPS = (1000003, 1000033, 1000037)


class Mixture:
    def __init__(
        self, docs: DataFrame, shards: int = 16, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int | None = None, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    ) -> None:
        if shards < 1 or most < 1 or not weights or min(weights) < 1 or (block is not None and block < 1):
            raise ValueError("shards, weights, repeats and blocks must be at least 1")
        self.shards, self.weights, self.most, self.seed = shards, weights, most, seed
        self.space = Workspace(docs.sparkSession, "mixing")
        text = text_of(text_col)
        name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))  # null last
        drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
        rows = docs.select(F.col(id_col).alias("doc_id"), name.alias("stratum"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.conv(F.substring(drawn, 1, 15), 16, 10).cast("long").alias("key"))
        self.rows = self.space.table(rows.groupBy("doc_id", "stratum", "size", "key").agg(F.count("*").alias("copies")), "rows")
        whole = self.rows.agg(F.count("*").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("words")).first()
        self.words = whole.words or 0
        self.buckets = max(1, min(MOST_BUCKETS, whole.rows // BUCKET_ROWS))
        self.block = block or max(1, min(BLOCK, self.words // LEAST_BLOCKS))

    def _bucketed(self) -> DataFrame:
        place = F.floor(F.col("key").cast("double") / F.lit(2.0**60) * self.buckets)
        return self.rows.withColumn("bucket", F.least(place, F.lit(self.buckets - 1)))

    @cached_property
    def _starts(self) -> DataFrame:
        """(stratum, bucket, before, words): where each bucket begins in its source's stream."""
        per = self._bucketed().groupBy("stratum", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        before = F.sum("words").over(Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        return self.space.table(per.withColumn("before", F.coalesce(before, F.lit(0))), "starts")

    @cached_property
    def sources(self) -> DataFrame:
        """(stratum, place, weight, source_size, target)."""
        sizes = self.space.table(self._starts.groupBy("stratum").agg(F.sum("words").alias("source_size")), "sizes")
        weight = F.element_at(F.array(*[F.lit(w) for w in self.weights]), (F.col("place") % len(self.weights) + 1).cast("int"))
        weighed = self.space.table(numbered(sizes, [F.col("stratum")], "place", self.space).withColumn("weight", weight), "weighed")
        cap = self.most * F.col("source_size")
        left, weights, capped = self.words, weighed.agg(F.sum("weight")).first()[0] or 1, 0
        while True:  # each round caps more sources, so the level rises
            share = F.col("weight") * F.lit(float(left)) / F.lit(float(weights))
            now = weighed.where(share > cap).agg(F.count("*").alias("n"), F.sum(cap).alias("words"), F.sum("weight").alias("weights")).first()
            if now.n == capped:
                return self.space.table(weighed.withColumn("target", F.least(share, cap.cast("double"))), "sources")
            capped, left = now.n, self.words - now.words
            weights = weighed.agg(F.sum("weight")).first()[0] - now.weights

    @cached_property
    def quotas(self) -> DataFrame:
        """(stratum, ends): how many blocks a source has given when each shard is full."""
        n, total = self.sources.count(), max(self.words, 1)
        blocks = (2 * self.words + self.block) // (2 * self.block)
        ends = F.explode(F.sequence(F.lit(1), F.lit(self.shards))).alias("shard")
        wide = self.sources.where("target > 0").select("stratum", "place", "source_size", "target", ends).withColumn("m", F.expr(f"shard * cast({blocks} as bigint) div {self.shards}"))

        def seats(m: Column) -> Column:
            """Blocks of a source whose quotients are at least total / m."""
            return F.floor(F.col("target") * m / F.lit(float(total)) + F.lit(0.5))

        sure = F.greatest(F.lit(0).cast("long"), seats(F.greatest(F.lit(0.0), F.col("m") - n / 2)) - 1)
        wide = wide.withColumn("sure", sure).withColumn("most", seats(F.col("m") + n / 2) + 1)
        open_seats = F.explode(F.sequence(F.col("sure") + 1, F.greatest("most", F.col("sure") + 1))).alias("seat")
        ranked = wide.select("stratum", "place", "shard", "m", "sure", "source_size", "target", open_seats)
        best = Window.partitionBy("shard").orderBy((F.col("target") / (F.col("seat") - F.lit(0.5))).desc(), "place", "seat")
        own = Window.partitionBy("shard")
        first = F.when(F.col("seat") == F.col("sure") + 1, F.col("sure")).otherwise(0)
        ranked = ranked.withColumn("rank", F.row_number().over(best)).withColumn("held", F.sum(first).over(own))
        given = F.col("sure") + F.count_if(F.col("rank") <= F.col("m") - F.col("held"))
        given = ranked.groupBy("stratum", "shard", "sure", "source_size").agg(given.alias("given"))
        given = given.withColumn("given", F.least("given", F.expr(f"{self.most} * source_size div {self.block}")))
        return self.space.table(given.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("shard", "given")))["given"].alias("ends")), "quotas")

    def documents(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken, and what ``pieces`` needs: start (in the stream), quota, ends."""
        quota = F.coalesce(F.element_at("ends", -1), F.lit(0).cast("long"))
        sources = self.sources.join(self.quotas, "stratum", "left").select("stratum", "source_size", "target", quota.alias("quota"), "ends")
        starts = self._starts.select("stratum", "bucket", "before").join(sources, "stratum")
        inside = Window.partitionBy("stratum", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        placed = self._bucketed().withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))).join(starts, ["stratum", "bucket"])
        each = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        each = each.withColumn("start", F.col("before") + F.col("inside") + F.col("copy") * F.col("size"))
        taken = sum((F.greatest(F.lit(0).cast("long"), F.least("size", self._room(r))) for r in range(1, self.most)), F.greatest(F.lit(0).cast("long"), F.least("size", self._room(0))))
        return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "start", "quota", "ends")

    def _room(self, repeat: int) -> Column:
        """Words of the quota from a document's start in a repeat of the stream."""
        return F.col("quota") * self.block - F.col("start") - repeat * F.col("source_size")

    def pieces(self) -> DataFrame:
        """(doc_id, shard, repeat, block, first, words): the runs of words of each document that go to each shard, cut where blocks end."""
        repeat = F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))).alias("repeat")
        runs = self.documents().where("taken > 0").select("doc_id", "size", "source_size", "start", "quota", "ends", repeat)
        begin = F.col("start") + F.col("repeat") * F.col("source_size")
        runs = runs.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota") * self.block)).where("end > begin")
        runs = runs.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {self.block}"), F.expr(f"(end - 1) div {self.block}"))))
        step = F.when(F.col("quota") % STEPS[0] != 0, STEPS[0]).when(F.col("quota") % STEPS[1] != 0, STEPS[1]).otherwise(STEPS[2])
        turn = (F.col("block") * step + F.lit(self.seed)) % F.col("quota")
        shard = F.size(F.filter("ends", lambda e: e <= F.col("turn")))
        low, high = F.greatest("begin", F.col("block") * self.block), F.least("end", (F.col("block") + 1) * self.block)
        return runs.withColumn("turn", turn).select("doc_id", shard.alias("shard"), "repeat", "block", (low - F.col("begin")).alias("first"), (high - low).alias("words"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return Mixture(docs, **options).documents().select("doc_id", "size", "source_size", "target", "taken")
