"""Numbers and running maxima by ranges equal those of a plain loop, however rows are spread over keys."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sourcewell.operators.ordered import numbered
from sourcewell.operators.storage import sequence_events

SCHEMA = "run_id long, at long, id long, progress int, note string"


def expected(rows):
    runs, out = defaultdict(list), set()
    for row in rows:
        runs[row[0]].append(row)
    for run in runs.values():
        best = None
        for i, row in enumerate(sorted(run, key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            best = row[3] if best is None else best if row[3] is None else max(best, row[3])
            out.add((*row, i, best))
    return out


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_equals_a_loop(spark, ranges):
    # One run has most rows; others have one or few; one key and some values are null.
    rows = [(None if i % 97 == 0 else 5 if i % 3 else i % 40, None if i % 50 == 7 else i * 7919 % 1000, i, None if i % 11 == 0 else i * 31 % 101, "n") for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, SCHEMA), ["run_id"], ["at", "id"], "sequence", {"best": "progress"}, ranges)
    assert {tuple(r) for r in got.collect()} == expected(rows)


def test_a_huge_run_is_spread(spark):
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("at"), "id", (F.col("id") % 101).cast("int").alias("progress"), F.lit("").alias("note"))
    got = sequence_events(rows, ["at", "id"])
    per_task = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 30_000
    assert got.where("sequence = id + 1").count() == 40_000


def test_empty_and_repeated_rows(spark):
    assert numbered(spark.createDataFrame([], SCHEMA), ["run_id"], ["at"]).count() == 0
    same = spark.createDataFrame([(1, 1, 1, 1, "x")] * 5, SCHEMA)
    assert sorted(r.sequence for r in numbered(same, ["run_id"], ["at", "id"], ranges=3).collect()) == [1, 2, 3, 4, 5]
