"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put in a seeded random order; row r (from 1) of a source with n rows gets
the fraction (r - 1/2) / n; all rows sorted by fraction are cut into equal runs. Every run then
holds each source in its share of the corpus, to within a row or so, and shard sizes differ by at
most one row.

No window spans a whole source or the whole table: both orders are dealt out by range, and rows are numbered inside their range
(``plans.order``). Each order ends in the number that a row got when it was first written, so ranges also part rows that are alike, be they equal
rows or the many sources of one row that all have the fraction 1/2. A source that holds a third of all rows is a third of all ranges.

Defined results: null text is empty (size 1), a null source is a source of its own, null ids are
ordinary rows, repeated rows each get a place of their own, an empty table gives an empty result,
more shards than rows leaves some shards empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import numbered
from .common import Workspace, text_of


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    space = Workspace(docs.sparkSession, "sharding")
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("stratum"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")).withColumn("own", F.monotonically_increasing_id())
    rows = space.table(rows, "rows")
    total = rows.count()

    # Rank inside each source.
    ranked = numbered(rows, [F.col(c) for c in ("stratum", "shuffled", "doc_id", "text_crc32", "own")], "rank", space)
    first = ranked.groupBy("stratum").agg(F.min("rank").alias("first"), F.count("*").alias("of"))
    fraction = (F.col("rank") - F.col("first") + F.lit(0.5)) / F.col("of")
    ranked = space.table(ranked.join(first, "stratum").withColumn("fraction", fraction).drop("rank", "first", "of"), "fractions")

    # Rank over all sources by fraction.
    order = [F.col("fraction"), F.xxhash64(F.lit(seed), "stratum"), *[F.col(c) for c in ("shuffled", "doc_id", "text_crc32", "own")]]
    placed = numbered(ranked, order, "place", space).withColumn("shard", F.expr(f"cast(place * {shards} div {max(1, total)} as int)"))
    start = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
