import json

from sourcewell.operators import normalize, storage
from sourcewell.sources import schemas


def test_tables_are_created_and_filled(spark):
    assert len(schemas.TABLES) == 19
    schemas.create_tables(spark, "t_")
    raw = spark.createDataFrame([(json.dumps({"photo": {"id": "k1", "caption": "c", "timestamp": 5}, "author": {"id": "u"}}), "kw", 7)], "payload string, source_keyword string, modified long")
    rows = schemas.conform(normalize.kuaishou_videos(raw), "kuaishou_video")
    rows.write.insertInto("t_kuaishou_video")
    table = spark.table("t_kuaishou_video")
    assert table.first().create_time == 5 and table.first().last_modify_ts == 7
    again = storage.upsert_snapshot(table, rows.withColumn("last_modify_ts", rows.last_modify_ts + 1), list(schemas.TABLES["kuaishou_video"][1]))
    assert [r.last_modify_ts for r in again.collect()] == [8]
    schemas.create_tables(spark, "t_")
