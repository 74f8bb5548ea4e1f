"""Working tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where it is unset and all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tarmac.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarmac-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("tarmac.shared.dir", found)
    return found.rstrip("/")


_scratch: ContextVar[tuple[list[Workspace], ...]] = ContextVar("scratch", default=())
_open: set[Workspace] = set()


@contextmanager
def scratch() -> Iterator[None]:
    """Working tables made inside, by this thread, are removed at the end: for callers that have written their result by then."""
    mine: list[Workspace] = []
    before = _scratch.set((*_scratch.get(), mine))
    try:
        yield
    finally:
        _scratch.reset(before)
        for space in mine:
            space.close()


@atexit.register
def _close_all() -> None:
    """Tables of results that nobody wrote inside ``scratch`` go when the program ends, if its session still runs."""
    for space in list(_open):
        with suppress(Exception):
            space.close()


#: Most bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Workers are sent a few megabytes at a time, however long rows are. The session's bound is lowered once, and one that is lower stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application with this one's settings and others of its own, so that no other thread sees them change."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        with suppress(AnalysisException):  # settings of the application are the same anyway
            own.conf.set(key, value)
    return own


class Workspace:
    """Working tables of one operator run, as Parquet under the shared folder.

    Writing a table cuts lineage with replicated or durable storage, so a lost executor costs a
    re-read and not a recomputation. Tables that only feed later ones are dropped with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _open.add(self)
        if _scratch.get():
            _scratch.get()[-1].append(self)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tarmac_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, table._tarmac_path)

    def close(self) -> None:
        """Remove all tables; those of a program that never calls this go when it ends."""
        _open.discard(self)
        delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop, so that it works on any file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
