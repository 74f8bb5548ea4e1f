"""Networks send only tables that are known to be small to all tasks."""

from __future__ import annotations

from tarmac.sources.network import FILES_SENT, Network


def test_tables_are_not_sent_by_the_size_of_their_files(spark, tmp_path):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.range(200_000).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    n = Network(spark, str(tmp_path))
    plan = n.sql("SELECT u, v, w FROM v_raw")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert int(n.spark.conf.get(key)) == FILES_SENT and spark.conf.get(key) == before
    assert n.edges.count() == 200_000 - 5_000 + 200_000 - 40 and n.objects.count() == 10
