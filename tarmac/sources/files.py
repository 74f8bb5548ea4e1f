"""Readers and writers of graphs, coordinates, assignments and objects, and caches of derived tables.

Text formats are read by Spark's text and CSV sources, so large files are split over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.graph import canonical
from ..plans.work import delete


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.col("f")[0] != "")


def read_arcs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(u, v, w) rows of a DIMACS graph as they stand. Comments and the header are skipped; ``strict`` fails on other lines."""
    rows = _fields(spark, path).where(~F.col("f")[0].isin("c", "p"))
    arc = (F.col("f")[0] == "a") & (F.size("f") == 4)
    if strict:
        rows = rows.select(F.when(arc, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not a graph line: "), F.array_join("f", " ")))).alias("f"))
    else:
        rows = rows.where(arc)
    return rows.select(*[F.col("f")[k].cast("bigint").alias(c) for k, c in ((1, "u"), (2, "v"), (3, "w"))])


def read_graph(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Canonical edges of a DIMACS graph."""
    return canonical(read_arcs(spark, path, strict))


def write_graph(edges: DataFrame, path: str) -> None:
    both = edges.select(F.explode(F.array(F.concat_ws(" ", F.lit("a"), "u", "v", "w"), F.concat_ws(" ", F.lit("a"), "v", "u", "w"))).alias("value"))
    both.write.mode("overwrite").text(path)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(vid, x, y) of the ``v`` lines; other lines are skipped, a file without any is an error."""
    rows = _fields(spark, path).where((F.col("f")[0] == "v") & (F.size("f") == 4))
    out = rows.select(F.col("f")[1].cast("bigint").alias("vid"), F.col("f")[2].cast("double").alias("x"), F.col("f")[3].cast("double").alias("y"))
    if out.isEmpty():
        raise ValueError(f"no coordinates in {path}")
    return out


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """(vid, part) of a two-column CSV with or without a header."""
    rows = spark.read.schema("vid string, part string").csv(path)
    return rows.select(F.expr("try_cast(trim(vid) as bigint)").alias("vid"), F.expr("try_cast(trim(part) as bigint)").alias("part")).where("vid is not null and part is not null")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(obj_id, u, v, offset_) of ``a u v offset`` lines, numbered from 0 in file order.

    Numbers come from the file, the block and the place in it, in two steps, so no task sees all lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = lines.select("file", "at", F.split(F.trim("value"), r"\s+").alias("f")).where(F.col("f")[0] == "a")
    rows = rows.withColumn("block", F.shiftright("at", 33))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("at")
    numbered = rows.join(first, "block").withColumn("obj_id", F.col("before") + F.row_number().over(inside) - 1)
    return numbered.select("obj_id", *[F.col("f")[k].cast("bigint").alias(c) for k, c in ((1, "u"), (2, "v"), (3, "offset_"))])


def write_objects(objects: DataFrame, path: str) -> None:
    """``a u v offset`` lines that ``read_objects`` reads back, in the order of obj_id."""
    rows = objects.orderBy("obj_id").select(F.concat_ws(" ", F.lit("a"), "u", "v", "offset_").alias("value"))
    rows.write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, form: str = "csv") -> None:
    if form == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def graph_key(edges: DataFrame, **options: object) -> str:
    """A key for what is derived from a graph: an order-free digest of its edges, with the options."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v", "w").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("w", "v", "u")).alias("x")).first()
    import hashlib

    return hashlib.sha256(json.dumps([row.n, str(row.s), row.x, options], sort_keys=True).encode()).hexdigest()[:32]


class TableCache:
    """Derived tables as Parquet under ``root/key``. Modes: off, read, write, auto (read, else write), refresh.

    A table counts as there only with its success mark, which Spark writes last, so a broken write is not read.
    """

    def __init__(self, spark: SparkSession, root: str, mode: str = "auto") -> None:
        if mode not in ("off", "read", "write", "auto", "refresh"):
            raise ValueError(f"no such mode: {mode}")
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode

    def table(self, key: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{key}/{name}"
        if self.mode == "off":
            return make()
        there = exists(self.spark, f"{path}/_SUCCESS")
        if self.mode in ("read", "auto") and there:
            return self.spark.read.parquet(path)
        if self.mode == "read":
            raise FileNotFoundError(path)
        if self.mode == "refresh" or not there:
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, key: str) -> None:
        delete(self.spark, f"{self.root}/{key}")
