from pyspark.sql import functions as F

from sourcewell.operators import storage
from sourcewell.streaming import runs

SCHEMA = "id long, note string, add_ts long, last_modify_ts long"


def table(spark, path):
    return {r.id: (r.note, r.add_ts, r.last_modify_ts) for r in storage.read_keyed(spark, path, ["id"]).collect()}


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("part-*")}


def test_batches_touch_their_buckets_only(spark, tmp_path):
    path = tmp_path / "t"
    base = spark.createDataFrame([(i, "a", 1, 1) for i in range(200)], SCHEMA)
    storage.write_deltas(base, str(path), ["id"], 0, 16)
    before = files(path)
    delta = spark.createDataFrame([(3, "b", 5, 5), (500, "new", 6, 6), (4, "old", 0, 0)], SCHEMA)
    for _ in range(2):  # an epoch that comes again changes nothing
        storage.write_deltas(delta, str(path), ["id"], 1, 16)
        after = files(path)
        assert {k: v for k, v in after.items() if "epoch=0" in str(k)} == before and len(after) - len(before) <= 3
        got = table(spark, str(path))
        assert got[3] == ("b", 1, 5) and got[500] == ("new", 6, 6) and got[4] == ("a", 0, 1) and len(got) == 201
    assert 1 <= storage.compact(spark, str(path), ["id"], most=1) <= 3
    assert table(spark, str(path)) == got and storage.compact(spark, str(path), ["id"], most=1) == 0
    storage.write_deltas(delta, str(path), ["id"], 1, 16)  # once more, after it was merged
    assert table(spark, str(path)) == got
    untouched = {k for k in before if k in files(path)}
    assert len(untouched) >= len(before) - 3


def test_stream_of_deltas(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(3):
        spark.createDataFrame([(i, f"{n}", 10 + n, 10 + n) for i in range(n, 20)], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = runs.delta_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), path, ["id"], str(tmp_path / "cp"), 4)
        query.awaitTermination(60)
        assert query.exception() is None
    got = table(spark, path)
    assert got == {i: (str(min(i, 2)), 10, 10 + min(i, 2)) for i in range(20)}
    assert spark.read.parquet(path).agg(F.count_distinct("epoch")).first()[0] == 3
