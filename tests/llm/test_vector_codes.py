import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from sourcewell.llm.oracles import vector_codes_sql
from sourcewell.llm.vector_codes import Codebook, codes, compress, decode, stored, train, whole_numbers

SCHEMA = "vec_id long, embedding array<float>, label int, code string, same int"


def brute(rows):
    """The contract in plain Python: no lists, no marks, no numpy."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((dist(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(4):
        places = [[near(v, p)[1] for p in range(4)] for _, v, _ in kept]
        for p in range(4):
            for e in set(x[p] for x in places):
                own = [cut(v, p) for (_, v, _), x in zip(kept, places, strict=True) if x[p] == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[near(v, p) for p in range(4)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(
        (str(i), "".join(f"{e:02x}" for _, e in f), err, sum(o for o, (_, _, x) in zip(errors, kept, strict=True) if x == label), sha)
        for (i, _, label), f, err in zip(kept, found, errors, strict=True)
    )


def result(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("entries,width,spread", [(1, 3, 50), (2, 1, 2), (40, 2, 4), (256, 16, 900), (256, 1, 30), (100, 4, 1)])
def test_search_equals_every_distance(entries, width, spread):
    rng = np.random.default_rng(entries * width)
    book = rng.integers(-spread, spread + 1, (entries, width))  # small spreads: many ties and equal entries
    points = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (3000, width)), book])
    found, near = Codebook(book).search(points)
    d = ((points[:, None] - book[None]) ** 2).sum(2)
    assert (found == d.argmin(1)).all() and (near == d.min(1)).all()


def test_search_measures_fewer_than_all():
    rng = np.random.default_rng(5)
    book = Codebook(rng.integers(-1000, 1000, (256, 2)))
    seen = []
    lists = book.lists

    class Watched:
        def __getitem__(self, key):
            out = lists[key]
            seen.append(out.size)
            return out

    book.lists = Watched()
    book.search(rng.integers(-1000, 1000, (500, 2)))
    assert sum(seen) < 500 * 100


def test_compress_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(8)], rng.choice([None, 1, 2]), "x", i) for i in range(700)]
    rows += rows[:30] + [(5, [1.0] * 8, 3, "y", 0), (None, [2.0] * 8, 3, "y", 0), (None, [-0.0] * 8, None, "y", 0)]
    rows += [(900, None, 1, "", 0), (901, [], 1, "", 0), (902, [1.0] * 7 + [None], 1, "", 0), (903, [1.0] * 7 + [float("nan")], 1, "", 0), (904, [float("-inf")] * 8, 1, "", 0)]
    rng.shuffle(rows)
    want = brute([(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label, *_ in rows])
    for parts in (1, 7):
        assert result(compress(spark.createDataFrame(rows, SCHEMA).repartition(parts).select("*"))) == want
    con = duckdb.connect()
    table = spark.createDataFrame(rows, SCHEMA).toArrow()
    con.register("embeddings", table)
    assert sorted((str(r[0]), *r[1:]) for r in con.execute(vector_codes_sql()).fetchall()) == want


def test_few_and_no_rows(spark):
    assert compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert compress(spark.createDataFrame([(1, None, 1, "", 0)], SCHEMA)).collect() == []
    one = result(compress(spark.createDataFrame([(1, [0.1] * 4, None, "", 0)] * 2, SCHEMA)))
    assert [r[:4] for r in one] == [("1", "00000000", 0, 0)] * 2
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, [0.1] * 4, 1, "", 0), (2, [0.1] * 8, 1, "", 0)], SCHEMA))


def test_query_equals_sql(spark):
    from sourcewell.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    got = queries.op11_vector_codes(spark, sf)
    want = con.execute(queries.oracle_sql()["op11_vector_codes"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_decoded_vectors_are_near(spark):
    rows = stored(whole_numbers(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")))
    books = train(rows)
    for r in decode(codes(rows, books), books).join(rows, "vec_id").limit(50).collect():
        error = sum((a - 1024 * b + 0.5) ** 2 for a, b in zip(r.ints, r.decoded, strict=True))
        assert abs(error - r.error) < 1e-3
