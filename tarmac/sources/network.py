"""A road network, moving objects and queries derived from the tables of a data folder.

The text is plain SQL that other engines run too, which is how results are checked. Vertices form a grid ``WIDTH``
wide over ``part``; ``events`` are position updates. ``ctes`` gives the definitions for a WITH clause.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.work import Workspace, session_with

WIDTH = 40
#: Edges are numbered in the order of their ends, block by block of so many vertices.
BLOCK = 4096

CTES = f"""
v_raw AS (
  SELECT a.p_partkey + 1 AS u, b.p_partkey + 1 AS v, a.p_size + b.p_size + 10 AS w FROM {{part}} a JOIN {{part}} b ON b.p_partkey = a.p_partkey + 1 WHERE (a.p_partkey + 1) % {WIDTH} <> 0
  UNION ALL
  SELECT a.p_partkey + 1 AS u, b.p_partkey + 1 AS v, a.p_size + b.p_size + 10 AS w FROM {{part}} a JOIN {{part}} b ON b.p_partkey = a.p_partkey + {WIDTH}),
v_blocks AS (
  SELECT block, CAST(coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(n) OVER () AS BIGINT) AS n_edges
  FROM (SELECT CAST(floor(u / {BLOCK}) AS BIGINT) AS block, count(*) AS n FROM v_raw GROUP BY CAST(floor(u / {BLOCK}) AS BIGINT)) c),
v_edges AS (
  SELECT CAST(b.before + row_number() OVER (PARTITION BY b.block ORDER BY r.u, r.v) - 1 AS BIGINT) AS edge_idx, b.n_edges, CAST(r.u AS BIGINT) AS u, CAST(r.v AS BIGINT) AS v, CAST(r.w AS BIGINT) AS w
  FROM v_raw r JOIN v_blocks b ON b.block = CAST(floor(r.u / {BLOCK}) AS BIGINT)),
v_positions AS (
  SELECT p.event_id, p.ts, p.user_id AS obj_id, e.u, e.v, e.w, CAST(1 + (p.event_id * 31) % (e.w - 1) AS BIGINT) AS offset_
  FROM (SELECT ev.event_id, ev.ts, ev.user_id, CAST((ev.event_id * 7919 + ev.user_id * 104729) % n.n AS BIGINT) AS ei FROM {{events}} ev CROSS JOIN (SELECT max(n_edges) AS n FROM v_edges) n) p
  JOIN v_edges e ON e.edge_idx = p.ei),
v_objects AS (
  SELECT obj_id, u, v, w, offset_ FROM (SELECT p.*, row_number() OVER (PARTITION BY obj_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_positions p) x WHERE rn = 1),
v_queries AS (
  SELECT CAST(q.k AS BIGINT) AS query_id, e.u, e.v, e.w, CAST(1 + (q.k * 17) % (e.w - 1) AS BIGINT) AS offset_
  FROM (SELECT k, CAST((k * 997 + 13) % n.n AS BIGINT) AS ei FROM (VALUES (0), (1), (2), (3), (4)) AS t(k) CROSS JOIN (SELECT max(n_edges) AS n FROM v_edges) n) q
  JOIN v_edges e ON e.edge_idx = q.ei)"""


def ctes(part: str = "part", events: str = "events") -> str:
    return CTES.format(part=part, events=events)


#: Files of whole numbers hold many times their size in rows, so by the size of files millions of rows would be sent to all tasks, by way of
#: the driver. Only very small files are; other tables once their rows were counted, by adaptive execution.
FILES_SENT = 256 << 10


def _session(spark: SparkSession) -> SparkSession:
    """A session for networks, with the limit above where its own is higher."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= FILES_SENT:
        return spark
    counted = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or str(now)
    return session_with(spark, {key: str(FILES_SENT), "spark.sql.adaptive.autoBroadcastJoinThreshold": counted})


class Network:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = _session(spark)
        self.space = Workspace(self.spark, "network")
        self._with = ctes(f"parquet.`{sf_dir}/part.parquet`", f"parquet.`{sf_dir}/events.parquet`")

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(f"WITH {self._with} {query}")

    # Queries read these many times; written out, they also keep plans small.

    @cached_property
    def edges(self) -> DataFrame:
        return self.space.table(self.sql("SELECT u, v, w FROM v_edges"), "edges")

    @cached_property
    def positions(self) -> DataFrame:
        return self.space.table(self.sql("SELECT * FROM v_positions"), "positions")

    @cached_property
    def objects(self) -> DataFrame:
        return self.space.table(self.sql("SELECT * FROM v_objects"), "objects")

    def queries(self, radius: int | None = None, k: int | None = None) -> DataFrame:
        more = (f", CAST({radius} AS BIGINT) AS radius" if radius is not None else "") + (f", {k} AS k" if k is not None else "")
        return self.space.table(self.sql(f"SELECT *{more} FROM v_queries"), "queries")

    @property
    def _vertices(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("u", "v")).alias("vid")).distinct()

    @property
    def coords(self) -> DataFrame:
        """Vertices on a unit grid, in the row-major order of their numbers."""
        return self._vertices.select("vid", ((F.col("vid") - 1) % WIDTH).cast("double").alias("x"), F.expr(f"cast((vid - 1) div {WIDTH} as double)").alias("y"))

    def parts(self, size: int = 10) -> DataFrame:
        return self._vertices.select("vid", F.expr(f"cast((vid - 1) div {size} as bigint)").alias("part"))
