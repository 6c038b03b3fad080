"""Held-out accuracy and edge cases of the trained classifiers."""

import random
import zlib

import numpy as np
import pytest

from sourcewell.llm import language_id, quality

WORDS = {
    "aa": "the of and ing tion er an thing ever which with there".split(),
    "bb": "der die und ung keit lich schen einer nicht mit auf".split(),
    "cc": "que los ción para una del mente ado con por está".split(),
}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 2))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, sentence(rng, lang, rng.randint(3, 400)), lang, "x"))
    rows += [(1000, None, "aa", "x"), (1001, "", "bb", "x"), (1002, "12 34 !!", "cc", "x"), (1003, sentence(rng, "aa", 20000), None, "x"), (5, rows[5][1], rows[5][2], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_languages_on_held_out_documents(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.train_and_identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[1003].lang_pred == "aa" and not by[1003].rejected


def test_language_model_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.train_and_identify(df).collect()] == ["und"]
    assert language_id.train_and_identify(df.limit(0)).count() == 0


def test_many_labels_each_get_a_dictionary(spark):
    """More than a hundred labels of a few documents: a text with a label's own words goes to it, as brute force says."""
    rng = random.Random(4)
    rows = []
    for k in range(130):
        own = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(30)]
        rows += [(10 * k + j, " ".join(rng.choices(own, k=120)), f"l{k}") for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert len(model) == 130
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.97
    for i, text, _ in rows[::97]:  # every size written out, the smallest wins
        data = language_id.normalised(text)
        sizes = language_id.sizes(data, model)
        assert got[i].lang_pred == model[sizes.index(min(sizes))][0]


def test_quality_scores_equal_written_out_sums(spark):
    """The score of a row is the logistic of the bias and one entry of each table, looked up one by one."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.choice(sorted(WORDS)), rng.randint(1, 90)) if i % 2 else "A" * i + "!!") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    x = quality.features([t for _, t in rows])
    for k, (i, _) in enumerate(rows):
        total = model.bias + sum(t[int((e <= v).sum())] for t, e, v in zip(model.tables, model.edges, x[k], strict=True))
        coarse = [int((e <= v).sum()) for e, v in zip(model.pair_edges, x[k], strict=True)]
        total += sum(t[coarse[a], coarse[b]] for t, (a, b) in zip(model.pair_tables, model.pairs, strict=True))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_on_held_out_documents(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        text = sentence(rng, rng.choice(sorted(WORDS)), rng.randint(5, 200)).capitalize() + "."
        bad = i % 3 == 0
        if bad:
            text = rng.choice([text.upper(), text.replace(" ", "!! "), " ".join([text[:6]] * 50), text.replace(" ", " | ")])
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(2000, None), (2001, ""), (2002, "x" * 100_000), (7, rows[7][1])]
    labels += [(3000, 1, 0), (2000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.train_and_score(docs, marks).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    again = {r.doc_id: r.score for r in quality.train_and_score(docs, marks).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert model.pairs[0] == (0, 1)
    assert ((model.score(x[2000:]) >= 0.5) == (y[2000:] == 1)).mean() > 0.9


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.train_and_score(docs, none).collect()} == {0.5}
    assert quality.train_and_score(docs.limit(0), none).count() == 0
