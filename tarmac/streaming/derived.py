"""Rows derived from objects' places, kept up by the objects that moved.

Each epoch writes the derived rows of its moved objects beside those of earlier epochs, and their ids. A row counts if no
later epoch has moved its object, so an epoch writes as many rows as its moves need, whatever the number of objects, and one that is run again writes
the same folder again. ``compact`` makes one epoch of all; a reader that is cut short by it reads again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skeleton import Skeleton
from ..plans.work import delete
from .positions import PLACE, anchor_buckets


class DerivedRows:
    """Border costs, least ways to a border and buckets of objects."""

    KINDS = ("places", "costs", "suffix")

    def __init__(self, spark: SparkSession, path: str, skeleton: Skeleton) -> None:
        self.spark, self.root, self.skeleton, self.epoch = spark, path, skeleton, -1

    def _path(self, kind: str, epoch: int | None = None) -> str:
        return f"{self.root}/{kind}" + (f"/epoch={epoch}" if epoch is not None else "")

    def apply(self, changes: DataFrame, gone: DataFrame | None = None, epoch: int | None = None) -> None:
        """Take in the new places of objects that moved or are new, and the ids of those that are gone. The first call has all objects."""
        epoch = self.epoch + 1 if epoch is None else epoch
        places = changes.select("obj_id", *PLACE)
        ids = places.select("obj_id") if gone is None else places.select("obj_id").unionByName(gone.select("obj_id"))
        before = self.table("places", epoch).join(ids, "obj_id", "left_semi") if epoch else None
        buckets = anchor_buckets(places)
        if before is not None:
            buckets = buckets.unionByName(anchor_buckets(before).withColumn("n", -F.col("n"))).groupBy("kind", "key_u", "key_v").agg(F.sum("n").alias("n")).where("n != 0")
        buckets.write.mode("overwrite").parquet(self._path("buckets", epoch))
        ids.distinct().write.mode("overwrite").parquet(self._path("moved", epoch))
        places.write.mode("overwrite").parquet(self._path("places", epoch))
        written = self.spark.read.parquet(self._path("places", epoch))
        self.skeleton.border_costs(written).write.mode("overwrite").parquet(self._path("costs", epoch))
        costs = self.spark.read.parquet(self._path("costs", epoch))
        self.skeleton.suffix(written, costs).write.mode("overwrite").parquet(self._path("suffix", epoch))
        self.epoch = epoch

    def _rows(self, kind: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", self._path(kind)).parquet(self._path(kind))
        return rows if before is None else rows.where(F.col("epoch") < before)

    def table(self, kind: str, before: int | None = None) -> DataFrame:
        """Rows of one kind as they are now, or were before an epoch."""
        if kind == "buckets":
            return self._rows(kind, before).groupBy("kind", "key_u", "key_v").agg(F.sum("n").alias("n")).where("n != 0")
        last = self._rows("moved", before).groupBy("obj_id").agg(F.max("epoch").alias("last"))
        return self._rows(kind, before).join(last, "obj_id").where("epoch = last").drop("epoch", "last")

    def written(self, epoch: int) -> dict[str, int]:
        """Rows that an epoch wrote, by kind."""
        return {kind: self.spark.read.parquet(self._path(kind, epoch)).count() for kind in (*self.KINDS, "buckets", "moved")}

    def compact(self) -> None:
        """One epoch in place of all."""
        for kind in (*self.KINDS, "buckets"):
            self.table(kind).write.mode("overwrite").parquet(self._path(f"{kind}-new"))
        self.table("places").select("obj_id").write.mode("overwrite").parquet(self._path("moved-new"))
        for kind in (*self.KINDS, "buckets", "moved"):
            new = self.spark.read.parquet(self._path(f"{kind}-new"))
            new.write.mode("overwrite").parquet(self._path(kind, self.epoch))
            for epoch in range(self.epoch):
                delete(self.spark, self._path(kind, epoch))
            delete(self.spark, self._path(f"{kind}-new"))
