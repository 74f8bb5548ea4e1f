from __future__ import annotations

import glob
from datetime import datetime

from pyspark.sql import functions as F

from tarmac.streaming import positions

LOG = "event_id long, ts timestamp, obj_id long, u long, v long, w long, offset_ long"


def _row(k: int, second: int, obj_id: int, offset: int) -> tuple:
    return k, datetime(2024, 1, 1, 0, 0, second), obj_id, 1, 2, 100, offset


def _job(spark, path):
    """One query that holds offsets up to 50 of the only edge."""
    asked = spark.createDataFrame([(0, 100)], "query_id long, radius long")
    index = spark.createDataFrame([(0, 1, 2, 50, 101)], "query_id long, u long, v long, low long, high long")
    return positions.StandingCounts(spark, path, index, asked)


def _arrive(spark, job, path: str, rows: list[tuple]) -> int:
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
    job.run(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path))
    return job.counts().first().result_count


def test_no_python_runs_for_each_object(spark, tmp_path, monkeypatch):
    """Python took a call for each object and micro-batch, and each row of the log."""
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda *a: (_ for _ in ()).throw(AssertionError("rows went through Python")))
    job, log = _job(spark, f"{tmp_path}/job"), f"{tmp_path}/log"
    assert _arrive(spark, job, log, [_row(0, 5, 7, 10), _row(1, 6, 8, 90)]) == 1
    assert _arrive(spark, job, log, [_row(2, 1, 8, 20)]) == 1  # late
    assert _arrive(spark, job, log, [_row(0, 5, 7, 10)]) == 1  # again
    assert _arrive(spark, job, log, [_row(3, 7, 8, 30), _row(4, 8, 8, 40), _row(5, 9, 7, 60)]) == 1
    assert _arrive(spark, job, log, [_row(6, 9, 7, 50)]) == 2  # as late as the last one, with a greater number


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "MERGE", 1)
    job, log = _job(spark, f"{tmp_path}/job"), f"{tmp_path}/log"
    for k in range(3):
        _arrive(spark, job, log, [_row(k, k, 7, 10 + 40 * k), _row(9 + k, k, k, 10)])
    assert job.counts().first().result_count == 3  # objects 0 to 2; 7 is at 90
    # The next batch was written but not committed: what it left is not what batches before it left.
    rows = spark.createDataFrame([_row(20, 20, 7, 10)], LOG)
    rows.select("obj_id", "ts", "event_id", *positions.PLACE).withColumn("batch", F.lit(3)).write.parquet(f"{job.places.out}/3")
    assert job.places.before(3).where("obj_id = 7").first().offset_ == 90
    assert _arrive(spark, job, log, [_row(20, 20, 7, 10)]) == 4
    assert len(glob.glob(f"{job.places.out}/*")) == 1


def test_the_log_has_as_many_files_as_tasks(spark, tmp_path, monkeypatch):
    """Six files, however many rows, were written and read by six tasks at most."""
    from tarmac import catalog

    seen = []
    run = positions.StandingCounts.run
    monkeypatch.setattr(positions.StandingCounts, "run", lambda self, stream: (seen.append(len(stream.sparkSession.read.parquet(*_logs(self)).inputFiles())), run(self, stream))[1])
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", 18)
    assert catalog.QUERIES["streamed_counts"](own, "/root/testdata/sf0.001").count() == 5
    assert seen[0] > 6


def _logs(job) -> list[str]:
    return glob.glob(f"{job.out.removeprefix('file:').rsplit('/', 2)[0]}/*-log")


def test_places_are_merged_while_a_run_lasts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(positions, "MERGE", 1)
    job, log = _job(spark, f"{tmp_path}/job"), f"{tmp_path}/log"
    merged, merge = [], job.places._merge
    monkeypatch.setattr(job.places, "_merge", lambda running=None: (merged.append(running), merge(running))[1])
    for k in range(4):
        spark.createDataFrame([_row(k, k, 7, (10, 90, 20, 80)[k]), _row(9 + k, k, k, 10)], LOG).coalesce(1).write.mode("append").parquet(log)
    job.run(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(log))
    assert job.counts().first().result_count == 4 and 2 in merged
