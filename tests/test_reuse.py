"""Media that come again are reused: against a loop, over batches, restarts and repeated batches."""

import random

from pyspark.sql import functions as F

from sourcewell.streaming import reuse


def test_stream_against_a_loop(spark, tmp_path):
    random.seed(5)
    schema, index, out, log = "id long, content_hash string", str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "log")
    seen, want = set(), {}
    for part in range(3):
        rows = [(part * 1000 + i, None if i % 10 == 0 else "hot" if i % 3 == 0 else f"h{random.randrange(60)}") for i in range(80)]
        for i, h in rows:
            want[i] = h is not None and h in seen
            seen.add(h)
        random.shuffle(rows)
        spark.createDataFrame(rows, schema).write.mode("append").json(log)
        reuse.reuse(spark.readStream.schema(schema).json(log), index, out, str(tmp_path / "checkpoint"), ["id"]).awaitTermination()
    got = spark.read.parquet(out)
    assert {r.id: r.reused for r in got.collect()} == want and got.count() == 240
    # the last batch again, and an empty one: nothing changes
    last = got.where("epoch = 2").select("id", "content_hash")
    reuse.reuse_batch(spark.createDataFrame(last.collect(), schema), 2, index, out, ["id"])
    reuse.reuse_batch(last.limit(0), 3, index, out, ["id"])
    assert {r.id: r.reused for r in spark.read.parquet(out).collect()} == want and spark.read.parquet(index).count() == len(seen - {None})


def test_repeated_rows(spark, tmp_path):
    """Equal rows: one is new, the others are reused."""
    index, out = str(tmp_path / "i"), str(tmp_path / "o")
    spark.createDataFrame([], reuse._INDEX).write.partitionBy("bucket", "epoch").parquet(index)
    reuse.reuse_batch(spark.createDataFrame([(1, "a")] * 3 + [(2, None)] * 2, "id long, content_hash string"), 0, index, out, ["id"])
    assert sorted((r.id, r.reused) for r in spark.read.parquet(out).collect()) == [(1, False), (1, True), (1, True), (2, False), (2, False)]


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    rows = spark.range(500).select("id", F.col("id").cast("string").alias("content_hash"))
    index, out = str(tmp_path / "i"), str(tmp_path / "o")
    spark.createDataFrame([], reuse._INDEX).write.partitionBy("bucket", "epoch").parquet(index)
    reuse.reuse_batch(rows, 0, index, out, ["id"])
    known = reuse._index(spark, index).where(F.col("bucket").isin([3, 4]) & (F.col("epoch") < 1))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and 0 < known.count() < 500
