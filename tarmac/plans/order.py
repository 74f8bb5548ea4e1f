"""Row numbers over a whole table without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import Workspace

#: ``monotonically_increasing_id`` has the partition above these bits and the row of the partition in them.
ROW_BITS = 33


def numbered(frame: DataFrame, order: list[Column], name: str, space: Workspace) -> DataFrame:
    """The frame with row numbers from 0 in the given order, which should end in a column that tells equal rows apart.

    Rows are dealt by range of the order, sorted inside their partition and written with partition and place; partitions' sizes, as many rows as
    there are shuffle partitions, give each one's first number. No task sees more than its range. The frame is read twice
    (ranges are found by a sample), so it should be a written table.
    """
    session = frame.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = space.table(dealt, "ordered")
    part = F.shiftright("_at", ROW_BITS).cast("int").alias("_part")
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = table.groupBy(part).agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    joined = table.withColumn("_part", part).join(F.broadcast(first), "_part")  # a row for each partition
    return joined.withColumn(name, F.col("_first") + inside).drop("_at", "_part", "_first")
