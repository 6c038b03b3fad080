import random

import pytest

from sourcewell.functions import automaton
from sourcewell.operators import report


def brute(text, term):
    return (len(text) - len(text.replace(term, ""))) // len(term)


@pytest.mark.parametrize("size", [8 << 20, 12])
def test_sums_equal_each_term_alone(spark, monkeypatch, size):
    """All terms at once, in one automaton or in blocks, count as each term alone does."""
    monkeypatch.setattr(automaton, "TERM_BYTES", size)
    rng = random.Random(1)
    texts = [(i % 3, "".join(rng.choices("ab 降噪", k=rng.randint(0, 60)))) for i in range(80)] + [(0, None), (1, "")]
    terms = ["a", "aa", "ab", "ba b", "a a", "降噪", "噪降", "b", "zz", "aba"]
    df = spark.createDataFrame(texts, "run_id int, text string")
    wanted = spark.createDataFrame([(t,) for t in terms * 2], "term string")
    for spaceless in (False, True):
        got = {(r.run_id, r.term): r.n for r in automaton.term_sums(df, wanted, ["run_id"], spaceless).collect()}
        want = {}
        for run, text in texts:
            for t in terms:
                n = brute(text or "", t)
                n = max(n, brute((text or "").replace(" ", ""), t.replace(" ", ""))) if spaceless else n
                want[run, t] = want.get((run, t), 0) + n
        assert got == {k: n for k, n in want.items() if n}


def test_sources_of_terms_in_any_case(spark):
    sources = spark.createDataFrame([(1, 1, "The Best"), (1, 2, None), (2, 3, "the best the"), (2, 4, "no")], "run_id int, source_id int, title string")
    terms = spark.createDataFrame([(1, "THE"), (1, "the"), (2, "best"), (2, ""), (3, "no")], "run_id int, term string")
    from pyspark.sql import functions as F

    got = sorted((r.run_id, r.source_id, r.term) for r in report.term_sources(sources, terms, F.col("title")).collect())
    assert got == [(1, 1, "THE"), (1, 1, "the"), (2, 3, "best")]


def test_no_terms(spark):
    df = spark.createDataFrame([(1, "x")], "run_id int, text string")
    assert automaton.term_sums(df, spark.createDataFrame([], "term string"), ["run_id"]).collect() == []
