import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sourcewell.llm.bpe_codec import Lexicon, compile_lexicon, decode, encode, round_trip
from sourcewell.llm.bpe_core import vocabulary
from sourcewell.llm.token_counts import token_counts

PATH = P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "   a", "a  b\n\n c", "it's 're 'r 'rx 'll 'lx 'l", "''s", "'s's", " 's", "\n's", "x'S", "a<|endoftext|>b <|endoftext|>", "12 3\t\t4\r\n", "日本語テキスト 한국어", "\x85\x1c y", "é́̀a 😀😀", "'ve'vee'v", "　'd", "z" * 3000, "ab" * 900 + " " * 700 + "q", "x" * 30 + "\x00\x01", "tie tie tie"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    parts = [" ", "\n", "'s", "'", "the", "ing", "é", "ß", "1", "22", "!", "<|endoftext|>", "\t", "Ñ", "re", "token", " ", "語"]
    return ODD + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_token_counts_equal_the_library(spark, texts, library):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, n_bytes int")
    got = {r.doc_id: r for r in token_counts(df, PATH, limit=40).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 40), t


def test_round_trip_equals_the_library(spark, texts, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id long, text string")
    got = {r.doc_id: r for r in round_trip(df, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == sha(",".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_encode_then_decode_is_exact(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in decode(encode(df, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(df, PATH).count() == 0
    assert round_trip(df, PATH).count() == 0


def test_lexicon_shares_suffixes_and_finds_exactly_its_words():
    words = sorted({(a + b + c).encode() for a in "xyzé" for b in ["in", "on", ""] for c in ["ing", "ed", ""]} - {b""})
    ids = [[k, k + 1] for k in range(len(words))]
    data = compile_lexicon(words[::-1], ids[::-1])
    lexicon = Lexicon(data)
    assert [lexicon.find(w) for w in words] == ids
    assert all(lexicon.find(w) is None for w in [b"", b"xi", b"q", b"xinging", b"\xc3"])
    trie = len({w[:i] for w in words for i in range(len(w) + 1)})
    assert len(lexicon.finals) < trie / 2


def test_merge_of_long_words_equals_the_library(library):
    vocab, rng = vocabulary(PATH), random.Random(3)
    for k in (25, 60, 400):
        for _ in range(30):
            word = "".join(rng.choices("aberhtinzo", k=k))
            assert vocab.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids
