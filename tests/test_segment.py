import math
import random

import pytest

from sourcewell.functions import segment
from sourcewell.operators import report


def every_path(run, scores, unknown):
    """All ways to cut a run, written out: the highest sum, of equal ones the longest first words."""
    def cuts(rest):
        if not rest:
            yield ()
        for j in range(1, len(rest) + 1):
            if j == 1 or rest[:j] in scores:
                for more in cuts(rest[j:]):
                    yield (rest[:j], *more)

    return list(max(cuts(run), key=lambda p: (sum(scores.get(w, unknown) for w in p), [len(w) for w in p])))


@pytest.mark.parametrize("size", [16 << 20, 0])
def test_best_path_equals_all_paths(spark, monkeypatch, size):
    monkeypatch.setattr(segment, "LEXICON_BYTES", size)
    rng = random.Random(5)
    words = {"".join(rng.choices("天地人和大小", k=rng.randint(1, 4))): rng.randint(1, 400) for _ in range(60)}
    runs = sorted({"".join(rng.choices("天地人和大小新", k=rng.randint(1, 11))) for _ in range(60)})
    total = sum(words.values())
    scores = {w: round(1e6 * (math.log(f) - math.log(total))) for w, f in words.items()}
    lexicon = spark.createDataFrame(sorted(words.items()), "word string, freq long")
    got = segment.segmented(spark.createDataFrame([(r, 1) for r in runs], "run string, n int"), lexicon).collect()
    assert {r.run: r.words for r in got} == {r: every_path(r, scores, round(-1e6 * math.log(total))) for r in runs}


def test_custom_words_stay_whole(spark):
    lexicon = spark.createDataFrame([("高", 90), ("频", 80), ("词", 70), ("高频", 60), ("很", 10), ("", 5), ("低", 0)], "word string, freq long")
    text = spark.createDataFrame([("高频词很高 Spark-4 spark-4",), (None,), ("",), ("高频词，低频词",)], "text string")
    cut = lambda custom: {r.run: r.words for r in segment.segmented(segment.runs(text), lexicon, custom).collect()}
    assert cut(None)["高频词很高"] == ["高频", "词", "很", "高"]
    assert cut({"高频词": None})["高频词很高"] == ["高频词", "很", "高"] and cut({"高频词": 500})["高频词"] == ["高频词"]
    assert cut({"高频词": None})["低频词"] == ["低", "频", "词"]
    got = {r.word: r.n for r in report.word_frequency(text, 20, ("很",), lexicon=lexicon, custom={"高频词": None}).collect()}
    assert got == {"高频词": 2, "高": 1, "spark-4": 2, "低": 1, "频": 1, "词": 1}


def test_no_lexicon(spark):
    empty = spark.createDataFrame([], "word string, freq long")
    got = segment.segmented(spark.createDataFrame([("天地",)], "run string"), empty).collect()
    assert [r.words for r in got] == [["天", "地"]]
