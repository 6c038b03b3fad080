"""Live events after stored ones: once, in order, with repeats, gaps and restarts."""

import datetime
import os

import pytest

from sourcewell.streaming import handover

SCHEMA = "run_id string, sequence long, type string, note string"


@pytest.fixture()
def rocks(spark):
    with handover.settings(spark, handover.DRAINED):
        yield spark


def follow(spark, tmp_path, batches, stored=None, **options):
    """Emitted rows by micro-batch; each list of events is one file and one batch."""
    for i, events in enumerate(batches):
        folder = tmp_path / "live"
        folder.mkdir(exist_ok=True)
        at = folder / f"{len(os.listdir(folder)):04d}.json"
        spark.createDataFrame(events, SCHEMA).toPandas().to_json(at, orient="records", lines=True)
        os.utime(at, (1_700_000_000 + 10 * len(os.listdir(folder)),) * 2)
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "live"))
    out = []
    query = handover.follow(live, stored, **options).writeStream.foreachBatch(lambda df, n: out.append([tuple(r) for r in df.select("run_id", "sequence").collect()]))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return out


def ev(run, *numbers, end=None):
    return [(run, n, "error" if n == end else "sources", f"n{n}") for n in numbers]


def flat(batches, run):
    return [n for b in batches for r, n in b if r == run]


def test_order_repeats_ends_and_stored(rocks, tmp_path):
    stored = rocks.createDataFrame(ev("a", 1, 2, 3) + ev("done", 1, 2, end=2), SCHEMA)
    got = follow(rocks, tmp_path, [ev("a", 6, 2, 3, 5) + ev("b", 2) + ev("done", 3), ev("a", 4, 5, 6, 7) + ev("b", 1, 1, 3, end=3), ev("a", 8, 8) + ev("b", 4)], stored)
    assert flat(got, "a") == [4, 5, 6, 7, 8] and flat(got, "b") == [1, 2, 3] and flat(got, "done") == []
    # A second start goes on from the checkpoint.
    assert flat(follow(rocks, tmp_path, [ev("a", 7, 8, 10, 9) + ev("b", 5)], stored), "a") == [9, 10]


def test_gap_is_given_up(rocks, tmp_path):
    got = follow(rocks, tmp_path, [ev("a", 1, 3, 4), ev("a", 6, 7), ev("a", 2, 5)], most=3)
    # Four wait for 2 after the second file: one gap goes, then 6 and 7 wait for 5; the late 2 stays out.
    assert flat(got, "a") == [1, 3, 4, 5, 6, 7]


def test_hold_ends(rocks, tmp_path):
    got = follow(rocks, tmp_path, [ev("a", 2), ev("b", 1), ev("b", 2), ev("b", 3)], hold=datetime.timedelta(0))
    assert flat(got, "a") == [2] and flat(got, "b") == [1, 2, 3]
