import random

import pytest
import xxhash

from sourcewell.llm.components import components
from sourcewell.llm.simhash import fingerprint, links, near_duplicates


def brute_print(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


TEXTS = [None, "", " \n", "One", "one", "ONE two", "Ä b C d", "a\x0bb\x0cc d", "a b c d", "x " * 50000, "a b c", "A B C"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_equals_brute_force(text):
    assert fingerprint(text) == brute_print(text)


def test_query_equals_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 60)) for _ in range(rng.randint(3, 200))] for _ in range(40)]
    texts = list(TEXTS)
    for words in base:
        for _ in range(5):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "edit"
            texts.append(" ".join(own))
    rows = [(1000 - i, t, "clash", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, fp int")).collect()}
    prints = {i: brute_print(t) for i, t, *_ in rows}
    expected = brute_components(prints)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert len(set(expected.values())) < len(rows) - 20


@pytest.mark.parametrize("limit", [256, 4])
def test_crowded_halves_link_the_same(spark, limit):
    rng = random.Random(limit)
    prints = set()
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(45):
            x = center
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << (rng.randrange(32) if rng.random() < 0.9 else rng.randrange(64))
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(30)}
    prints = dict(enumerate(sorted(prints, key=lambda x: rng.random())))
    nodes = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in prints.items()], "node long, fp long")
    roots = {r.node: r.root for r in components(links(nodes, limit)).collect()}
    assert {i: roots.get(i, i) for i in prints} == brute_components(prints)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (8, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 540)} | {9: 8}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmap_of_tables_with_its_own_column_names(spark):
    from sourcewell.llm.common import maybe_in

    docs = spark.createDataFrame([(i, f"w{i}", i, 7, "p") for i in range(50)], "doc_id long, __word string, __bits long, __place int, place string")
    ids = spark.createDataFrame([(3,), (4,)], "doc_id long")
    inside, outside = maybe_in(docs, ids).collect(), maybe_in(docs, ids, inside=False).collect()
    assert {tuple(r) for r in inside} | {tuple(r) for r in outside} == {tuple(r) for r in docs.collect()}
    assert {3, 4} <= {r.doc_id for r in inside} and len(inside) + len(outside) == 50


def test_components_with_a_hot_root(spark):
    from sourcewell.llm.components import components

    edges = [(i, 0) for i in range(1, 2000)] + [(5000 + i, 5000 + i + 1) for i in range(40)] + [(7, 7), (5001, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 2000)} | {5000 + i: 5000 for i in range(1, 41)}
