"""A stream over the event log gives what the batch gives."""

import datetime

from pyspark.sql import functions as F

from sourcewell.streaming import runs

T0 = datetime.datetime(2026, 1, 1)


def log(spark):
    kinds = ["run_started", "sources", "section_delta", "final_report", "error"]
    rows = [(f"r{r}", i + 1, kinds[(r * 3 + i) % 5], (i * 17 + r) % 101, f"m{i}", '{"status":"partial"}' if r == 2 else None, T0 + datetime.timedelta(seconds=30 * i + r)) for r in range(4) for i in range(7)]
    return spark.createDataFrame(rows, runs.EVENT_SCHEMA)


def drain(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_folds_equal_the_batch(spark, tmp_path):
    batch = log(spark)
    batch.repartition(3).write.json(str(tmp_path / "log"))
    stream = runs.tail(spark, str(tmp_path / "log"))
    for name, fold in (("state", runs.run_state), ("stages", runs.stage_progress)):
        got = drain(fold(stream), tmp_path, name, "complete")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, fold(batch).collect()), key=repr)
    state = {r.run_id: r for r in runs.run_state(batch).collect()}
    assert state["r2"].status in ("running", "partial", "failed")


def test_replayed_events_count_once(spark, tmp_path):
    batch = log(spark)
    batch.unionByName(batch).repartition(2).write.json(str(tmp_path / "log"))
    got = drain(runs.once(runs.tail(spark, str(tmp_path / "log"))), tmp_path, "onceonly", "append")
    assert got.count() == batch.count()


def test_windows_and_sessions(spark, tmp_path):
    log(spark).write.json(str(tmp_path / "log"))
    stream = runs.tail(spark, str(tmp_path / "log"))
    assert drain(runs.event_windows(stream), tmp_path, "windows", "complete").agg(F.sum("n")).first()[0] == 28
    assert runs.run_sessions(log(spark)).count() == 4


def test_stale_runs_are_cancelled(spark):
    got = {r.status for r in runs.cancel_stale(runs.run_state(log(spark))).collect()}
    assert "running" not in got


def test_sections(spark):
    rows = [("r", "s", 1, False, "a"), ("r", "s", 2, False, "b"), ("r", "s", 3, True, "AB"), ("r", "s", 4, False, "c"), ("r", "t", 1, False, "x")]
    got = {r.section_id: r.text for r in runs.sections(spark.createDataFrame(rows, "run_id string, section_id string, sequence long, complete boolean, text string")).collect()}
    assert got == {"s": "ABc", "t": "x"}


def test_upsert_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1, 1)], "id long, v string, add_ts long, last_modify_ts long")
    base.write.parquet(str(tmp_path / "t0"))
    spark.createDataFrame([(1, "b", 5, 5), (2, "c", 6, 6)], base.schema).write.json(str(tmp_path / "delta"))
    deltas = spark.readStream.schema(base.schema).json(str(tmp_path / "delta"))
    q = runs.upsert_stream(deltas, lambda s: s.read.parquet(str(tmp_path / "t0")), lambda df: df.write.mode("overwrite").parquet(str(tmp_path / "t1")), ["id"], str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t1")).collect())) == [(1, "b", 1, 5), (2, "c", 6, 6)]
