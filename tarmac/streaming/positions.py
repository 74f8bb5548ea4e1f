"""Positions that change: latest state, standing queries and the counters that follow them.

``positions(event_id, ts, obj_id, u, v, w, offset_)`` is append-only; an object is where its latest row by (ts,
event_id) says. Late rows change nothing, and rows that arrive again change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import graph
from ..operators.queries import object_distances, seeds
from ..plans.fixpoint import distances
from ..plans.work import delete

PLACE = ["u", "v", "w", "offset_"]
#: Batches whose changes are kept apart before they are merged.
MERGE = 8


def latest(positions: DataFrame) -> DataFrame:
    """(obj_id, u, v, w, offset_): an aggregate, so that equal keys are combined before the shuffle."""
    last = F.max(F.struct("ts", "event_id", *PLACE)).alias("last")
    return positions.groupBy("obj_id").agg(last).select("obj_id", *[f"last.{c}" for c in PLACE])


def transitions(positions: DataFrame) -> DataFrame:
    """Each row with the place it replaces (null for an object's first one)."""
    order = Window.partitionBy("obj_id").orderBy("ts", "event_id")
    return positions.select("event_id", "ts", "obj_id", *PLACE, *[F.lag(c).over(order).alias(f"old_{c}") for c in PLACE])


def effective(epochs: DataFrame) -> DataFrame:
    """Rows that are the latest of their object when they arrive (in the order of event_id), each with the place it replaces; late rows are left out."""
    arrived = Window.partitionBy("obj_id").orderBy("event_id")
    place = F.struct("ts", "event_id", *PLACE)
    seen = epochs.withColumn("before", F.max(place).over(arrived.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = seen.where(F.col("before").isNull() | (F.struct("ts", "event_id") > F.struct("before.ts", "before.event_id")))
    return fresh.select("epoch", "event_id", "ts", "obj_id", *PLACE, *[F.col(f"before.{c}").alias(f"old_{c}") for c in PLACE])


def epoch_counts(index: DataFrame, moves: DataFrame, queries: DataFrame) -> DataFrame:
    """(epoch, query_id, result_count): running sums of the membership changes of each epoch, from the first update on."""
    changes = _signed(index, moves, "epoch").groupBy("epoch", "query_id").agg(F.sum("one").alias("delta"))
    every = moves.select("epoch").distinct().crossJoin(F.broadcast(queries.select("query_id")))  # epochs by standing queries, which is the result
    so_far = Window.partitionBy("query_id").orderBy("epoch")
    rows = every.join(changes, ["epoch", "query_id"], "left").na.fill(0, ["delta"])
    return rows.select("epoch", "query_id", F.sum("delta").over(so_far).alias("result_count"))


def standing_fields(queries: DataFrame, edges: DataFrame, method: str = "auto") -> DataFrame:
    """The distance field of each standing query, computed once for many updates."""
    return distances(seeds(queries), graph.arcs(edges), method)


def within(field: DataFrame, objects: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, obj_id) of objects inside each standing query."""
    found = object_distances(field, objects)
    return found.join(queries.select("query_id", "radius"), "query_id").where("dist <= radius").select("query_id", "obj_id")


def counts(field: DataFrame, objects: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, result_count), zero counts too."""
    n = within(field, objects, queries).groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("result_count"))


def edge_index(field: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, u, v, low, high): where on an edge a query's result lies: offsets <= low or >= high."""
    du = field.select("query_id", F.col("vid").alias("u"), F.col("dist").alias("du"))
    dv = field.select("query_id", F.col("vid").alias("v"), F.col("dist").alias("dv"))
    by_u = edges.join(du, "u").select("query_id", "u", "v", "w", "du", F.lit(None).cast("bigint").alias("dv"))
    by_v = edges.join(dv, "v").select("query_id", "u", "v", "w", F.lit(None).cast("bigint").alias("du"), "dv")
    both = by_u.unionByName(by_v).groupBy("query_id", "u", "v", "w").agg(F.min("du").alias("du"), F.min("dv").alias("dv")).join(queries.select("query_id", "radius"), "query_id")
    low = F.coalesce(F.col("radius") - F.col("du"), F.lit(-1))
    high = F.coalesce(F.col("w") - (F.col("radius") - F.col("dv")), F.col("w") + 1)
    return both.select("query_id", "u", "v", low.alias("low"), high.alias("high"))


def deltas_by_query(field: DataFrame, moves: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, delta) of ``moves`` (as from ``transitions``), each standing query against old and new places."""
    new = within_rows(field, moves.select("event_id", *PLACE), queries)
    old = within_rows(field, moves.where("old_u is not null").select("event_id", *[F.col(f"old_{c}").alias(c) for c in PLACE]), queries)
    signed = new.withColumn("one", F.lit(1)).unionByName(old.withColumn("one", F.lit(-1)))
    return _summed(signed, queries)


def deltas_by_edge(index: DataFrame, moves: DataFrame, queries: DataFrame) -> DataFrame:
    """The same, by looking up only the queries that an old or new edge belongs to."""
    return _summed(_signed(index, moves, "event_id"), queries)


def _signed(index: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """(query_id, key, one): 1 for each new place inside a query, -1 for each old one."""
    places = F.array(F.struct(*[F.col(c).alias(c) for c in PLACE], F.lit(1).alias("one")), F.struct(*[F.col(f"old_{c}").alias(c) for c in PLACE], F.lit(-1).alias("one")))
    rows = moves.select(key, F.explode(places).alias("p")).select(key, "p.*").where("u is not null")
    hit = rows.join(index, ["u", "v"]).where((F.col("offset_") <= F.col("low")) | (F.col("offset_") >= F.col("high")))
    return hit.select("query_id", key, "one")


def within_rows(field: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    found = object_distances(field, rows.withColumnRenamed("event_id", "obj_id"))
    return found.join(queries.select("query_id", "radius"), "query_id").where("dist <= radius").select("query_id", F.col("obj_id").alias("event_id"))


def _summed(signed: DataFrame, queries: DataFrame) -> DataFrame:
    total = signed.groupBy("query_id").agg(F.sum("one").alias("delta"))
    return queries.select("query_id").join(total, "query_id", "left").select("query_id", F.coalesce("delta", F.lit(0)).cast("bigint").alias("delta"))


def anchor_buckets(objects: DataFrame) -> DataFrame:
    """(kind, key_u, key_v, n): objects by edge and by either end of it."""
    edge = objects.groupBy(F.col("u").alias("key_u"), F.col("v").alias("key_v")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    left = objects.groupBy(F.col("u").alias("key_u")).agg(F.count("*").alias("n")).withColumn("key_v", F.lit(None).cast("bigint")).withColumn("kind", F.lit("left"))
    right = objects.groupBy(F.col("v").alias("key_u")).agg(F.count("*").alias("n")).withColumn("key_v", F.lit(None).cast("bigint")).withColumn("kind", F.lit("right"))
    return edge.unionByName(left).unionByName(right).select("kind", "key_u", "key_v", "n")


def cell_buckets(objects: DataFrame, coords: DataFrame, side: int) -> DataFrame:
    """(cell, n): objects by grid cell."""
    placed = graph.grid_cells(graph.interpolate(objects, coords), coords, side)
    return placed.groupBy("cell").agg(F.count("*").alias("n"))


def relocate(objects: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """Objects at seeded places anywhere in the graph: slots are counted along edges, then looked up by range of slot."""
    slots = edges.where("w > 1").withColumn("n", F.col("w") - 1)
    # Order-preserving blocks keep the running sum out of one task.
    blocks = slots.withColumn("block", F.floor(F.col("u") / 4096))
    per = blocks.groupBy("block").agg(F.sum("n").alias("n"))
    first = per.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = per.agg(F.sum("n")).first()[0] or 0
    if not total:
        return objects.limit(0)
    inside = Window.partitionBy("block").orderBy("u", "v")
    placed = blocks.join(first, "block").withColumn("low", F.col("before") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    pick = objects.select("obj_id", F.pmod(F.xxhash64(F.lit(seed), "obj_id"), F.lit(total)).alias("slot"))
    # Slots of an edge lie in one or two runs of ``wide`` slots, which makes the range lookup an equality.
    wide = max(1, int(slots.agg(F.max("n")).first()[0]))
    runs = placed.select("u", "v", "w", "low", "n", F.explode(F.sequence(F.expr(f"low div {wide}"), F.expr(f"(low + n - 1) div {wide}"))).alias("run"))
    hit = pick.withColumn("run", F.expr(f"slot div {wide}")).join(runs, "run").where((F.col("slot") >= F.col("low")) & (F.col("slot") < F.col("low") + F.col("n")))
    return hit.select("obj_id", "u", "v", "w", (F.col("slot") - F.col("low") + 1).alias("offset_"))


def move_locally(objects: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """Objects on a seeded edge that shares an end with theirs (or their own if there is none)."""
    ends = edges.select("u", "v", "w", F.explode(F.array("u", "v")).alias("vid"))
    at = objects.select("obj_id", F.col("u").alias("ou"), F.col("v").alias("ov"), F.explode(F.array("u", "v")).alias("vid"))
    near = at.join(ends, "vid").where((F.col("u") != F.col("ou")) | (F.col("v") != F.col("ov")))
    pick = near.groupBy("obj_id").agg(F.min(F.struct(F.xxhash64(F.lit(seed), "obj_id", "u", "v").alias("h"), "u", "v", "w")).alias("e")).select("obj_id", "e.u", "e.v", "e.w")
    to = pick.where("w > 1").withColumn("offset_", 1 + F.pmod(F.xxhash64(F.lit(seed + 1), "obj_id"), F.col("w") - 1))
    return to.unionByName(objects.select("obj_id", "u", "v", "w", "offset_").join(to, "obj_id", "left_anti"))


class LatestPositions:
    """A streaming job that keeps the latest row of each object as a table in the shared folder.

    State is a streaming aggregation (combined before its shuffle) in the disk-backed store; each micro-batch appends the rows that
    changed under its own number, so a batch that runs again overwrites itself. When a run ends, they are merged into one table.
    """

    STORE = "spark.sql.streaming.stateStore.providerClass"
    DISK_BACKED = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.out, self.marks = spark, f"{path}/latest", f"{path}/checkpoint"
        spark.conf.set(self.STORE, self.DISK_BACKED)  # of the session that the stream was made in; it stays set

    def run(self, positions: DataFrame, on_batch: Callable[[DataFrame, int], None] | None = None) -> None:
        last = F.max(F.struct("ts", "event_id", *PLACE)).alias("last")
        state = positions.groupBy("obj_id").agg(last)

        def emit(batch: DataFrame, number: int) -> None:
            if len(self._folders(number)) > MERGE:
                self._merge(number)
            rows = batch.select("obj_id", "last.*").withColumn("batch", F.lit(number))
            rows.write.mode("overwrite").parquet(f"{self.out}/{number}")
            if on_batch:
                on_batch(self.spark.read.parquet(f"{self.out}/{number}"), number)

        query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", self.marks).trigger(availableNow=True).start()
        query.awaitTermination()
        self._merge()

    def _folders(self, running: int | None = None) -> list[str]:
        """Folders of rows, but for what a batch that is running has left if it ran before."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.out)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
        return [str(p) for p in found if p.getName() != str(running)]

    def _merge(self, running: int | None = None) -> None:
        """One table of the latest rows; rows that are there twice, if this is cut short, do no harm."""
        old = self._folders(running)
        if len(old) > 1:
            rows = self.spark.read.option("recursiveFileLookup", True).parquet(*old)
            last = rows.groupBy("obj_id").agg(F.max(F.struct("ts", "event_id", *PLACE, "batch")).alias("last"))
            last.select("obj_id", "last.*").write.parquet(f"{self.out}/merged-{uuid.uuid4().hex}")
            for path in old:
                delete(self.spark, path)

    def before(self, number: int) -> DataFrame | None:
        """As ``table`` while batch ``number`` runs: what the batches before it left."""
        old = self._folders(number)
        return latest(self.spark.read.option("recursiveFileLookup", True).parquet(*old).drop("batch")) if old else None

    def table(self) -> DataFrame:
        rows = self.spark.read.option("recursiveFileLookup", True).parquet(self.out)
        return latest(rows.drop("batch"))

    def close(self) -> None:
        delete(self.spark, self.out)
        delete(self.spark, self.marks)


class StandingCounts:
    """Counts of standing queries over a stream of positions, from the changes alone.

    The stream keeps the latest rows of objects (``LatestPositions``). A micro-batch gives, for each object whose place changed, one retraction of the
    place that the batches before it left and one addition of the new one, whatever the number of its rows in the batch; late and repeated rows give nothing.
    Joined with the edge index these are sums of changes by query, written under the batch's number, so a batch that runs again writes the same. Sums of
    batches are merged when a run ends.
    """

    def __init__(self, spark: SparkSession, path: str, index: DataFrame, queries: DataFrame) -> None:
        self.spark, self.out = spark, f"{path}/changes"
        self.index, self.queries = index, queries
        self.places = LatestPositions(spark, path)

    def run(self, positions: DataFrame) -> None:
        """Take in what is new in a streaming table of positions (``ts`` a timestamp)."""

        def emit(rows: DataFrame, number: int) -> None:
            old = self.places.before(number)
            old = rows.select("obj_id", *PLACE).limit(0) if old is None else old
            moves = rows.join(old.select("obj_id", *[F.col(c).alias(f"old_{c}") for c in PLACE]), "obj_id", "left")
            same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in PLACE]
            moves = moves.where(~(same[0] & same[1] & same[2] & same[3])).withColumn("event_id", F.lit(number).cast("bigint"))
            changes = _signed(self.index, moves, "event_id").groupBy("query_id").agg(F.sum("one").alias("delta")).where("delta != 0")
            changes.write.mode("overwrite").parquet(f"{self.out}/batch={number}")

        self.places.run(positions, emit)
        self._merge()

    def _changes(self) -> DataFrame:
        return self.spark.read.schema("query_id long, delta long, batch long").option("basePath", self.out).parquet(self.out)

    def _batches(self) -> list[int]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.out)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _merge(self) -> None:
        """Sums of all batches in the folder ``merged-N`` of the last one, N; what it covers is left out by readers even before it is removed."""
        batches = self._batches()
        if len(batches) > MERGE:
            self.counts(zeros=False).write.mode("overwrite").parquet(f"{self.out}-merged/upto={batches[-1]}")
            for number in batches:
                delete(self.spark, f"{self.out}/batch={number}")

    def _merged(self) -> int | None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.out}-merged")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # A folder counts when its write has been committed.
        done = [f.getPath() for f in files.listStatus(folder) if files.exists(f.getPath().suffix("/_SUCCESS"))] if files.exists(folder) else []
        return max((int(p.getName().removeprefix("upto=")) for p in done), default=None)

    def counts(self, zeros: bool = True) -> DataFrame:
        """(query_id, result_count) after all batches."""
        upto, rows = self._merged(), None
        if any(upto is None or b > upto for b in self._batches()):
            rows = self._changes().where(F.col("batch") > (-1 if upto is None else upto)).select("query_id", "delta")
        if upto is not None:
            base = self.spark.read.parquet(f"{self.out}-merged/upto={upto}").select("query_id", F.col("result_count").alias("delta"))
            rows = base if rows is None else rows.unionByName(base)
        if rows is None:
            rows = self.queries.select("query_id", F.lit(0).cast("bigint").alias("delta"))
        total = rows.groupBy("query_id").agg(F.sum("delta").alias("n"))
        if not zeros:
            return total.select("query_id", F.col("n").alias("result_count"))
        return self.queries.select("query_id").join(total, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("result_count"))

    def close(self) -> None:
        self.places.close()
        for path in (self.out, f"{self.out}-merged"):
            delete(self.spark, path)
