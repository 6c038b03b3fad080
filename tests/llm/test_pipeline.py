import random
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from sourcewell.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(30, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            own = list(base)
            for _ in range(max(1, int(len(own) * rng.choice([0.002, 0.01, 0.02, 0.1])))):
                own[rng.randrange(len(own))] = word()
            texts.append(rng.choice([" ", "\n "]).join(own))
    texts += [texts[0], texts[0].upper(), None, "", "one two", "One  two", "lonely words here"]
    rows = [(1000 - i, t, "en", None, 0, "x") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[5] + " z", None, "s", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = near_copies.drop_copies(df).collect()
    ids = {r.doc_id for r in kept}
    sets = {i: grams(t) for i, t, *_ in rows if i is not None}
    near = {i: {j for j in sets if j != i and jaccard(sets[i], sets[j]) >= 0.8} for i in sets}
    assert None in ids
    assert all(i in ids for i in sets if not near[i])  # clean documents stay
    root = {}
    for i in sorted(sets):
        if i in root:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += near[x]
    groups = Counter(root.values())
    assert ids - {None} == set(groups)
    assert all(Counter(r.doc_id for r in kept)[i] == 1 for i in ids)
    assert kept[0].asDict().keys() == df.limit(1).toPandas().to_dict(orient="list").keys()


def test_large_group_of_copies_stays_linear(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_copies._prints(df).selectExpr("doc_id as node", "n", "segments")
    assert near_copies._candidates(nodes).count() < 300 * 40
    assert [r.doc_id for r in near_copies.drop_copies(df).collect()] == [0]


def test_crowd_of_edits_that_are_too_far_makes_few_pairs(spark, monkeypatch):
    """Texts with too many words of their own share most shingles with a large group, yet hardly a pair needs a check."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        own = list(base)
        for k in range(1 if i < 80 else 4):
            own[5 + rng.randrange(25) + 36 * k] = f"e{i}x{k}"
        rows.append((i, " ".join(own)))
    rows.append((160, rows[100][1].replace(base[149], "twin")))
    sets = {i: grams(t) for i, t in rows}
    near = {i for i in sets if any(j < i and jaccard(sets[i], sets[j]) >= 0.8 for j in sets)}
    assert near == {*range(1, 80), 160}
    counts, possible = [], near_copies._possible
    monkeypatch.setattr(near_copies, "_possible", lambda nodes, pairs, s: (counts.append(pairs.count()), possible(nodes, pairs, s))[1])
    kept = near_copies.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == sets.keys() - near
    assert sum(counts) < len(rows) * 20


def test_appended_and_truncated_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    zipf = [1 / (i + 1) for i in range(3000)]
    rows = []
    for n in (60, 200, 800):
        for _ in range(40):
            own = rng.choices(words, zipf, k=n)
            pair = [own, own + rng.choices(words, zipf, k=int(n * 0.21))]
            if rng.random() < 0.5:
                pair.reverse()  # cut off instead of appended
            rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(pair)]
    near = {i + 1 for i in range(0, len(rows), 2) if jaccard(grams(rows[i][1]), grams(rows[i + 1][1])) >= 0.8}
    assert len(near) > 100
    got = near_copies.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == near


def test_pairs_in_a_crowd_need_no_link_to_the_first(spark):
    rng = random.Random(6)
    texts = [[f"t{i}x{rng.randint(0, 10**6)}" for _ in range(100)] for i in range(60)]
    texts[50] = texts[20] + ["more"] * 3
    texts[59] = texts[0][:90]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    sets = [near_copies._shingles(near_copies._words(" ".join(w))) for w in texts]
    nodes = spark.createDataFrame([(i, len(x), [7], bytearray(near_copies._sketch(x))) for i, x in enumerate(sets)], "node long, n int, segments array<long>, sketch binary")
    assert {(r.a, r.b) for r in near_copies.links(docs, nodes).collect()} == {(50, 20), (59, 0)}


def test_stages_on_small_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = df.count()
        out = stage(spark, df, sf).cache()
        assert out.columns == columns, name
        assert 0.7 * before <= out.count() <= before, name
        df = out
    last = corpus_pipeline.STAGES[-1][1](spark, df, sf)
    assert last.count() == df.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "redact_secrets", "encode"]


def test_stages_with_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None, None), (2, "", "en", "s", 0, ""), (3, "a few plain words of text", "en", "s", 25, "n"), (3, "a few plain words of text", "en", "s", 25, "n"), (4, "token = abcdefgh12 and words", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    item = "seven questions about the shape of rivers and 4 hills"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["language"](spark, df.where("lang is not null"), str(tmp_path)).collect()} <= {3}
    assert sorted(r.doc_id for r in stages["near_duplicates"](spark, df, str(tmp_path)).collect()) == [1, 3, 4]
    leak = df.unionByName(spark.createDataFrame([(9, f"intro. {item} end", "en", "s", 5, "n")], SCHEMA))
    assert 9 not in {r.doc_id for r in stages["decontaminate"](spark, leak, str(tmp_path)).collect()}
    clean = {r.doc_id: r for r in stages["redact_secrets"](spark, df, str(tmp_path)).collect()}
    assert clean[4].text == "[SECRET] and words" and clean[4].n_chars == 18 and clean[1].text is None and clean[3].n_chars == 25
    assert {r.doc_id: r.n_tokens for r in stages["encode"](spark, df, str(tmp_path)).collect()}[1] == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name


def test_pairs_come_from_simhash_links_and_are_checked(spark, monkeypatch):
    """Pairs that the operator's prints link join groups, if they are near, even where the prefix filter is shut off."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    other = list(base)
    other[300] = "changed"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "far from both of them"), (4, None), (5, "")], "doc_id long, text string")
    prints = near_copies._prints(docs).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in prints} == {r.doc_id: near_copies.fingerprint(r.text, near_copies.SHINGLE) for r in docs.collect()}
    nodes = spark.createDataFrame([(1, 0), (2, 0b111), (3, -1), (4, 0b1111), (5, -1)], "node long, fp long")
    assert {tuple(r) for r in near_copies._by_prints(nodes).collect()} >= {(2, 1), (4, 2), (5, 3)}
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near_copies, "_few_pairs", lambda *_: none)
    monkeypatch.setattr(near_copies, "_star_pairs", lambda *_: none)
    monkeypatch.setattr(near_copies, "_by_prints", lambda _: spark.createDataFrame([(2, 1), (3, 2)], "a long, b long"))
    assert {tuple(r) for r in near_copies.copies(docs).collect()} == {(2, 1), (5, 4)}


def test_stages_hand_small_batches_to_workers(spark, tmp_path):
    """Each stage by itself, not the whole run alone: its workers get few rows at once, whenever its result is made."""
    before = {name: spark.conf.get(name) for name in corpus_pipeline.BATCHES}
    df = spark.createDataFrame([(i, "some plain words", "en", "s", 16, "n") for i in range(3)], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    try:
        for _, stage in corpus_pipeline.STAGES:
            for name, value in before.items():
                spark.conf.set(name, value)
            out = stage(spark, df, str(tmp_path))
            assert {name: spark.conf.get(name) for name in corpus_pipeline.BATCHES} == corpus_pipeline.BATCHES
            assert "doc_id" in out.columns
        rows = spark.range(5000, numPartitions=1)
        sized = rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
        assert max(r.n for r in sized.collect()) <= 1000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
