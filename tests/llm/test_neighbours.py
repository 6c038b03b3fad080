import math

import numpy as np
import pytest

from sourcewell.llm import neighbours
from sourcewell.llm.neighbours import _nearest, balanced_partition, learn, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, part int, q string"


def brute(rows, asked, k=10):
    """Every distance, in plain Python."""
    fine = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in sorted(x for x in fine if asked(x[0])):
        near = sorted((math.dist(v, w), j) for j, w in fine if j != i)[:k]
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return out


def single(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def result(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def test_odd_rows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], 1, i, "x") for i in range(60)]  # many ties and equal vectors
    rows += [(i, [1.0, 2.0, 3.0, 4.0], 1, 0, "") for i in range(100, 140)] + rows[:9]
    rows += [(200, None, 1, 0, ""), (201, [], 1, 0, ""), (202, [0.0] * 4, 1, 0, ""), (203, [1.0, None, 1.0, 1.0], 1, 0, ""), (204, [1.0, float("nan"), 1.0, 1.0], 1, 0, ""), (None, [1.0] * 4, 1, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(nearest(df, df.where("vec_id % 20 = 0")))
    want = brute([(i, single(v)) for i, v, *_ in rows], lambda i: i % 20 == 0)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))


def test_few_rows(spark):
    assert result(nearest(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA))) == []
    one = spark.createDataFrame([(0, [1.0, 0.0], 1, 0, "")], SCHEMA)
    assert result(nearest(one, one)) == []
    three = spark.createDataFrame([(i, [1.0, float(i)], 1, 0, "") for i in range(3)], SCHEMA)
    assert [r[:3] for r in result(nearest(three, three.where("vec_id = 0")))] == [(0, 1, 1), (0, 2, 2)]
    with pytest.raises(ValueError):
        nearest(three.unionAll(spark.createDataFrame([(9, [1.0], 1, 0, "")], SCHEMA)), three)


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist(), 1, 0, "") for i in range(700)], SCHEMA).cache()
    whole = result(nearest(df, df.where("vec_id % 7 = 0")))
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    assert result(nearest(df, df.where("vec_id % 7 = 0"))) == whole


def test_partitions_are_balanced_and_keep_neighbours():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (100, 8)) for c in rng.normal(0, 3, (16, 8))])
    links = _nearest(points, points, 8, own=True)
    part = balanced_partition(links, 16)
    sizes = np.bincount(part)
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 4
    assert (part[links] == part[:, None]).mean() > 0.9


def test_clusters_need_few_partitions():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (200, 32))
    points = centres[rng.integers(0, 200, 9000)] + rng.normal(0, 0.15, (9000, 32))
    router = learn(points[:4000], 16)
    share, recall = router.visited(points[4000:]).mean(), []
    home = router.home(points)
    near = _nearest(points, points[4000:4300], 10)
    recall = np.take_along_axis(router.visited(points[4000:4300]), home[near], 1).mean()
    assert share < 0.35 and recall >= 0.93


@pytest.mark.parametrize("sf,every", [("sf0.1", 10), ("check_s", 100)])
def test_recall_of_all_rows(spark, sf, every):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    got = nearest(df, df.where(f"vec_id % {every} = 0")).toPandas()
    table = df.toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    found = total = 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(1))
        order = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found, total = found + len(set(order) & set(own.vec_id)), total + 10
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=0, atol=1e-12) and own.score.is_monotonic_increasing
    assert total == 10 * (ids % every == 0).sum() and found / total >= 0.93
