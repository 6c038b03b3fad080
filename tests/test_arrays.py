"""JSON arrays in pieces, and crawl files newest first."""

import glob
import json

from sourcewell.sources import io


def pieces(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_pieces_are_one_array(spark, tmp_path):
    """Concatenated by name, whatever the number of pieces: ties, nulls, brackets in texts, empty ranges, no rows."""
    df = spark.createDataFrame([(i // 2, None if i % 3 else f"[{i}],\n\"") for i in range(57)] + [(None, "]")], "id long, v string")
    want = sorted((json.dumps({k: x for k, x in r.asDict().items() if x is not None}, sort_keys=True) for r in df.collect()))
    for tasks in (1, 7, 90):
        path = str(tmp_path / f"a{tasks}")
        io.save_array(df.repartition(3), path, ["id"], tasks)
        got = json.loads(pieces(path))
        assert sorted(json.dumps(r, sort_keys=True) for r in got) == want
        assert [r.get("id", -1) for r in got] == sorted(r.get("id", -1) for r in got)
        assert sorted(map(str, io.read_array(spark, path, "id long, v string").collect())) == sorted(map(str, df.collect()))
    for name, rows in (("none", df.limit(0)), ("one", df.limit(1))):
        io.save(rows, str(tmp_path / name), "array", keys=("id",))
        assert len(json.loads(pieces(tmp_path / name))) == rows.count() == io.read_array(spark, str(tmp_path / name), "id long, v string").count()


def test_newest_files_first(spark, tmp_path):
    """Lines in their order, blank and corrupt ones not counted; what the limit doesn't need isn't opened."""
    d = tmp_path / "weibo" / "jsonl"
    d.mkdir(parents=True)
    for day in range(1, 8):
        lines = [json.dumps({"id": day * 100 + i}) for i in range(10)]
        (d / f"search_contents_2026-01-0{day}.jsonl").write_text("\n".join([*lines[:3], "", "{broken", *lines[3:]]) + "\n")
    want = [day * 100 + i for day in range(7, 0, -1) for i in range(10)]
    for limit in (0, 1, 4, 10, 25, 70, 500):
        assert [r.id for r in io.read_crawl(spark, str(tmp_path), "weibo", "id long", limit=limit).collect()] == want[:limit]
    read = io.read_crawl(spark, str(tmp_path), "weibo", "id long", limit=10).inputFiles()
    assert [f[-15:] for f in read] == ["2026-01-07.jsonl"[-15:]]
