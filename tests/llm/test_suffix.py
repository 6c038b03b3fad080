import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sourcewell.llm.suffix_array import common_prefixes, repeated_windows, suffix_array
from sourcewell.llm.suffix_dedup import remove_repeats

W = 200


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + W] for r in raws for i in range(len(r) - W + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - W + 1):
            if seen[r[i : i + W]] > 1:
                gone[i : i + W] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(n))
    passages = [prose(rng.randint(30, 90)) for _ in range(6)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 400, prose(60)[:200]]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            parts.append(rng.choice([prose(rng.randint(1, 40)), p, p[rng.randint(0, 30) :], p[: -rng.randint(1, 50)]]))
        texts.append(" ".join(parts))
    base = prose(120)
    for _ in range(20):
        words = base.split()
        words[rng.randrange(len(words))] = "edit" + str(rng.random())
        texts.append(" ".join(words))
    texts += [texts[12], texts[12], texts[7]]
    return texts


@pytest.mark.parametrize("limit", [8000, 3])
def test_query_equals_brute_force(spark, limit):
    texts = corpus(limit)
    rows = [(i, t, "", 0) for i, t in enumerate(texts)] + [(12, texts[12], "", 0), (None, texts[30], "", 0), (13, "other " + texts[14], "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string, a int")
    expected = brute([r[1] for r in rows])
    got = Counter(tuple(r) for r in remove_repeats(df, limit).collect())
    assert got == Counter((r[0], *e) for r, e in zip(rows, expected, strict=True))
    assert sum(0 < e[1] < e[0] for e in expected) > 20


def test_long_text_in_segments(spark, monkeypatch):
    import sourcewell.llm.suffix_dedup as sd

    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    texts = ["".join(rng.choices("abcdefgh ", k=5000)) + passage + "".join(rng.choices("abcdefgh ", k=900)), "q" * 1500, passage[100:]]
    monkeypatch.setattr(sd, "SEGMENT", 1000)
    rows = {k: [] for k in ("doc_id", "text")}
    rows["doc_id"], rows["text"] = [0, 1, 2], texts
    found = sd._run_rows(rows)
    covered = Counter()
    for doc, start, n in zip(found["doc_id"], found["start"], found["windows"], strict=True):
        covered.update((doc, start + k) for k in range(n))
    assert set(covered.values()) == {1} and len(covered) == sum(len(t) - W + 1 for t in texts)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    raw = "".join(rng.choices("ab", k=300) + ["abracadabra" * rng.randint(1, 30)] + ["x" * 90]).encode()
    text = np.frombuffer(raw, np.uint8)
    order = suffix_array(text)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = common_prefixes(text, order, 64, lanes=7)
    for k in range(1, len(raw)):
        a, b = raw[order[k] :], raw[order[k - 1] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == min(64, n)
    starts = np.array([rng.random() < 0.7 and i + 30 <= len(raw) for i in range(len(raw))])
    seen = Counter(raw[i : i + 30] for i in np.flatnonzero(starts))
    assert repeated_windows(text, starts, 30).tolist() == [bool(starts[i]) and seen[raw[i : i + 30]] > 1 for i in range(len(raw))]


@pytest.mark.parametrize("seed", range(60))
def test_windows_of_long_shared_stretches(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 4, 12, 26])]
    base, raw = rng.choices(letters, k=rng.randint(300, 460)), b""
    for _ in range(rng.randint(2, 8)):
        own = list(base)
        if rng.random() < 0.7:
            own[rng.randrange(len(own))] = rng.choice(letters)
        raw += ("".join(rng.choices(letters, k=rng.randint(0, 40))) + "".join(own)[rng.randint(0, 44) :]).encode()
    raw += b"\0" * rng.choice([0, 0, 3, 20])
    text = np.frombuffer(raw, np.uint8)
    assert suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    starts = np.arange(len(raw)) + W <= len(raw)
    seen = Counter(raw[i : i + W] for i in np.flatnonzero(starts))
    assert repeated_windows(text, starts, W).tolist() == [bool(s) and seen[raw[i : i + W]] > 1 for i, s in enumerate(starts)]


@pytest.mark.parametrize(("letters", "limit"), [("ab", 3), ("abcd", 8000), ("abcdefghijklmnopqrstuvwxyz", 3)])
def test_one_byte_edits_of_a_passage(spark, letters, limit):
    rng = random.Random(len(letters))
    base, rows = "".join(rng.choices(letters, k=340)), []
    for i in range(150):
        own = list(base)
        own[rng.randrange(len(own))] = rng.choice(letters)
        rows.append((i, "".join(rng.choices(letters, k=rng.randint(0, 60))) + "".join(own) + "".join(rng.choices(letters, k=rng.randint(0, 60)))))
    got = {r[0]: tuple(r)[1:] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows])
