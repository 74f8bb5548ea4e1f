"""Exact deduplication as a stateful stream over arrivals.

Arrivals (id, SHA-256 of the normalised text, code points, content locator) go to a log in the shared
folder, which a Structured Streaming query reads. Its keyed state is a streaming aggregation in
the disk-backed state store, never expires, and holds for each digest how many rows arrived and
the stable identifier and locator of the one that stays. A streaming aggregation combines equal
digests before its shuffle, so a group that a third of all rows belong to sends one row for each task.

A digest that several rows have is a hit, and its bytes are checked in the micro-batch that brings it: the locator, (id, hash of the
original text), leads to the full normalised bytes of the rows that came with this call and of the row that stayed until then, in the documents
that were taken in. Their least and greatest bytes, combined in each task before the shuffle, are equal, or the digest stands
for several texts and is written down as doubtful under the batch's number, so a batch that runs again writes the same. Rows of doubtful
digests are grouped by the bytes themselves.

A ``Deduplicator`` keeps its log, state and doubtful digests between calls of ``ingest``: later arrivals are judged
against all earlier ones, and a restart resumes from the checkpoint (and is given the documents of earlier calls again, to find the bytes of what
stayed). Updates of a batch are merged into one table when it ends.

Defined results: null text counts as empty, empty texts are equal to each other and to texts of white
space; of equal texts the longest stays, then the smallest id (a null id last); rows equal in id
and text are one document given repeatedly, all marked kept, and ``keep`` returns one of them; an
empty table gives an empty result; other columns are kept by ``keep`` and never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.work import session_with
from .common import Bitmap, Workspace, among, delete, digest, free_names, text_of

STORE = "spark.sql.streaming.stateStore.providerClass"
DISK_BACKED = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROCKS = "spark.sql.streaming.stateStore.rocksdb"
#: Without files that are allocated ahead (megabytes for each state partition, however small), and with buffers and caches that all partitions of an executor share.
SETTINGS = {STORE: DISK_BACKED, f"{ROCKS}.allowFAllocate": "false", f"{ROCKS}.boundedMemoryUsage": "true", f"{ROCKS}.maxMemoryUsageMB": "48", "spark.sql.streaming.stateStore.maintenanceInterval": "10s"}


def normalised(text: Column) -> Column:
    """Without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def text_digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def arrivals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        text_digest(text).alias("text_sha256"),
        F.char_length(text).cast("bigint").alias("n_chars"),
        digest(text).alias("locator"),
    )


def content(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of documents, where bytes are looked up."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))


class Deduplicator:
    def __init__(self, spark: SparkSession, space: Workspace | None = None, files_per_batch: int | None = None, earlier: DataFrame | None = None) -> None:
        """``earlier``: the documents (doc_id, text) of calls before a restart."""
        self.spark = spark
        self.space = space or Workspace(spark, "exact-dedup")
        self.files_per_batch, self.content = files_per_batch, earlier
        self.log, self.state, self.doubt, self.done, self.marks = (f"{self.space.root}/{p}" for p in ("log", "state", "doubtful", "calls", "checkpoint"))

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Append arrivals to the log and run the stream over what is new."""
        rows = arrivals(docs, id_col, text_col).withColumn("call", F.lit(uuid.uuid4().hex))
        rows.write.mode("append").parquet(self.log)
        more = content(docs, id_col, text_col)
        self.content = more if self.content is None else self.content.unionByName(more)
        source = session_with(self.spark, SETTINGS).readStream.schema(rows.schema)
        if self.files_per_batch:
            source = source.option("maxFilesPerTrigger", self.files_per_batch)
        # The complement falls as the id rises, for every id.
        stays = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("minus_id"), "locator"))
        state = source.parquet(self.log).groupBy("text_sha256").agg(F.count("*").alias("group_size"), stays.alias("stays"))

        def emit(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.state}/{number}")
            self._check(number)

        query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", self.marks).trigger(availableNow=True).start()
        query.awaitTermination()
        self.spark.createDataFrame([(c,) for c in self._open_calls()], "call string").coalesce(1).write.mode("append").parquet(self.done)
        self._compact()

    def _updates(self) -> DataFrame:
        schema = "text_sha256 string, group_size long, stays struct<n_chars: long, minus_id: long, locator: long>, batch int"
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.state)

    def _compact(self) -> None:
        """One table of the last update of each digest in place of one for each batch; the same update twice does no harm if this is cut short."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.state)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return
        old = [str(f.getPath()) for f in files.listStatus(hadoop)]
        if len(old) > 1:
            last = self._updates().groupBy("text_sha256").agg(F.max(F.struct("batch", "group_size", "stays")).alias("last"))
            last.select("text_sha256", "last.group_size", "last.stays", "last.batch").write.parquet(f"{self.state}/merged-{uuid.uuid4().hex}")
            for path in old:
                delete(self.spark, path)

    def _check(self, number: int) -> None:
        """Compare the full bytes of a batch's hits and write down digests that stand for several texts."""
        updates = self._updates()
        hits = updates.where((F.col("batch") == number) & (F.col("group_size") > 1)).select("text_sha256")
        new = self.seen().where(F.col("call").isin(self._open_calls())).join(hits, "text_sha256", "left_semi").select("text_sha256", "doc_id", "locator")
        last = updates.where(F.col("batch") < number).join(hits, "text_sha256", "left_semi").groupBy("text_sha256").agg(F.max(F.struct("batch", "stays")).alias("last"))
        stayed = last.select("text_sha256", F.bitwise_not(F.col("last.stays.minus_id")).alias("doc_id"), F.col("last.stays.locator").alias("locator"))
        wanted = self.space.table(new.unionByName(stayed).distinct(), "hits")
        if not wanted.isEmpty():
            found = self._bytes(wanted).groupBy("text_sha256").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
            found.where("low != high").select("text_sha256").write.mode("overwrite").parquet(f"{self.doubt}/{number}")

    def _open_calls(self) -> list[str]:
        """Calls whose rows the stream has not taken in as a whole: this one, and one that was cut short before."""
        known = self.seen().select("call").distinct()
        if self._exists(self.done):
            known = known.join(self.spark.read.parquet(self.done), "call", "left_anti")
        return [r["call"] for r in known.collect()]

    def _bytes(self, wanted: DataFrame) -> DataFrame:
        """(text_sha256, doc_id, locator, bytes) of the documents that ``wanted`` locates. They are picked by a filter that misses none, without a shuffle."""
        located = Bitmap.of(wanted.select(F.col("locator").alias("key")).distinct())
        rows = self.content.where(among(located, True)(digest(F.col("text"))))
        text = F.col("text")
        return rows.select("doc_id", digest(text).alias("locator"), normalised(text).cast("binary").alias("bytes"), text_digest(text).alias("text_sha256"))

    def groups(self) -> DataFrame:
        """The state after the last batch: text_sha256, group_size, keep_id, keep_locator."""
        last = self._updates().groupBy("text_sha256").agg(F.max(F.struct("batch", "group_size", "stays")).alias("last"))
        return last.select("text_sha256", "last.group_size", F.bitwise_not(F.col("last.stays.minus_id")).alias("keep_id"), F.col("last.stays.locator").alias("keep_locator"))

    def seen(self) -> DataFrame:
        return self.spark.read.parquet(self.log)

    def doubtful(self) -> DataFrame:
        """Digests found to stand for several texts."""
        return self.spark.read.schema("text_sha256 string").option("recursiveFileLookup", True).parquet(self.doubt).distinct()

    def result(self) -> DataFrame:
        """One row per document taken in so far: doc_id, keep_id, group_size, kept, text_sha256, locator."""
        judged = self.seen().join(self.groups(), "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256", "locator", "keep_locator", "n_chars")
        doubtful = self.space.table(self.doubtful(), "collisions") if self._exists(self.doubt) else None
        if doubtful is not None and not doubtful.isEmpty():
            judged = self.space.table(judged, "judged")
            wanted = judged.join(doubtful, "text_sha256", "left_semi")
            judged = _apart(judged, _others(judged, self._bytes(wanted), doubtful))
        return judged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")

    def _exists(self, path: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, locator."""
    engine = Deduplicator(docs.sparkSession)
    engine.ingest(docs, id_col, text_col)
    return engine.result()


def _others(judged: DataFrame, rows: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Rows of digests that stand for several texts whose bytes are not those of the row that stays."""
    rows = rows.join(doubtful, "text_sha256", "left_semi")
    stays = judged.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator")))
    stays = stays.join(doubtful, "text_sha256", "left_semi").select("text_sha256", F.col("doc_id").alias("stay_id"), F.col("locator").alias("stay_at"))
    at = (F.col("doc_id").eqNullSafe(F.col("stay_id"))) & (F.col("locator") == F.col("stay_at"))
    kept = rows.join(stays, "text_sha256").where(at).groupBy("text_sha256").agg(F.min("bytes").alias("kept_bytes"))
    return rows.join(kept, "text_sha256").where(F.col("bytes") != F.col("kept_bytes")).drop("kept_bytes")


def _apart(result: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose bytes are not those of the row that stays form groups by their bytes."""
    at = ["text_sha256", "doc_id", "locator"]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in at]
    marked = result.alias("a").join(other.dropDuplicates(at).alias("b"), same[0] & same[1] & same[2], "left").select("a.*", "b.bytes")
    whole = ["text_sha256", "bytes"]
    best = marked.where("bytes is not null").groupBy(*whole).agg(F.count("*").alias("n"), F.bitwise_not(F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("minus_id")))["minus_id"]).alias("best"))
    gone = marked.groupBy("text_sha256").agg(F.count("bytes").alias("gone"))
    rows = marked.join(best, whole, "left").join(gone, "text_sha256")
    return rows.select(
        "doc_id", "text_sha256", "locator", "n_chars",
        F.when(F.col("bytes").isNull(), F.col("keep_id")).otherwise(F.col("best")).alias("keep_id"),
        F.when(F.col("bytes").isNull(), F.col("group_size") - F.col("gone")).otherwise(F.col("n")).alias("group_size"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one for each distinct normalised text."""
    own, at, kept_id = free_names(docs, 3)
    found = deduplicate(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("locator").alias(at)).distinct()
    rows = docs.withColumn(own, digest(text_of(text_col)))
    joined = rows.join(found, F.col(id_col).cast("bigint").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(at)))
    return joined.dropDuplicates([at, kept_id]).select(*[joined[c] for c in docs.columns])
