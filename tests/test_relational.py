"""Keyed tables in a database: each row once, whatever tasks and batches do."""

import sqlite3
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sourcewell.sources import relational


def rows(path, table="t"):
    with sqlite3.connect(path) as c:
        return sorted(c.execute(f"select * from {table}").fetchall())


def test_upsert_and_read_back(spark, tmp_path):
    db = str(tmp_path / "a.db")
    first = spark.range(0, 1000, 1, 6).select("id", F.lit("first").alias("v"), F.lit(2).alias("m"))
    relational.upsert(first, db, "t", ["id"], "m", "1")
    second = spark.range(500, 1200, 1, 3).select("id", F.lit("second").alias("v"), (F.col("id") % 3 + 1).cast("int").alias("m"))
    for _ in range(2):  # a batch that comes again changes nothing
        relational.upsert(second, db, "t", ["id"], "m", "2")
    relational.upsert(first.withColumn("v", F.lit("lost")), db, "t", ["id"], "m", "1")
    want = {i: ("first", 2) for i in range(1000)} | {i: ("second", i % 3 + 1) for i in range(500, 1200) if i >= 1000 or i % 3 + 1 >= 2}
    assert {i: (v, m) for i, v, m in rows(db)} == want
    back = relational.read(spark, db, "t", "id long, v string, m int", "id", parts="5")
    assert back.rdd.getNumPartitions() == 6 and {r.id: (r.v, r.m) for r in back.collect()} == want
    assert [n for (n,) in sqlite3.connect(db).execute("select name from sqlite_master where name like '%stage%'")] == []


def test_kinds_nulls_and_empty(spark, tmp_path):
    db = str(tmp_path / "b.db")
    schema = "k string, d decimal(12,2), t timestamp, day date, b boolean, x double, raw binary, `odd \"name` int"
    df = spark.sql("select 'a' k, cast(1.5 as decimal(12,2)) d, timestamp'2024-02-03 04:05:06.789' t, date'2024-02-03' day, true b, 0.1d x, X'00ff' raw, 7 `odd \"name`")
    df = df.unionByName(spark.sql("select 'b' k, null d, null t, null day, null b, null x, null raw, null `odd \"name`"))
    relational.upsert(df, db, "t", ["k"])
    got = {r.k: r for r in relational.read(spark, db, "t", schema).collect()}
    want = {r.k: r for r in df.collect()}
    assert got == want and got["a"].d == Decimal("1.50")
    relational.upsert(df.limit(0), db, "t", ["k"])
    assert len(rows(db)) == 2
    relational.upsert(df.where("k = 'b'"), db, "t", ["k"], mode="overwrite")
    assert len(rows(db)) == 1
    relational.upsert(spark.createDataFrame([(1, "z"), (1, "z")], "k long, v string"), db, "twice", ["k", "v"])
    assert rows(db, "twice") == [(1, "z")]


def test_killed_repeated_and_doubled_tasks(tmp_path):
    """The writer's calls as Spark makes them, with an attempt that dies half-way and one that runs twice."""
    db = str(tmp_path / "c.db")
    schema = StructType([StructField("id", LongType()), StructField("v", StringType())])
    batch = lambda ids: pa.RecordBatch.from_pydict({"id": list(ids), "v": [f"v{i}" for i in ids]})
    options = {"database": db, "table": "t", "keys": "id", "batch": "3"}
    w = relational._Writer(options, schema, False)

    def dying():
        yield batch(range(0, 5))
        raise RuntimeError("executor lost")

    try:
        w.write(dying())
    except RuntimeError:
        pass
    w.write(iter([batch(range(5, 10))]))  # a speculative copy that Spark doesn't take
    done = [w.write(iter([batch(range(0, 5))])), w.write(iter([batch(range(5, 10))])), w.write(iter([]))]
    w.commit(done)
    assert rows(db) == [(i, f"v{i}") for i in range(10)]
    other = relational._Writer(options, schema, True)
    other.write(iter([batch(range(50, 60))]))
    other.abort([])
    assert len(rows(db)) == 10 and [n for (n,) in sqlite3.connect(db).execute("select name from sqlite_master where name like '%stage%'")] == []
