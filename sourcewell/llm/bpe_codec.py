"""BPE encoding and decoding with a lexicon of frequent words.

The words (pre-tokens) are counted over the whole corpus; the most frequent ones are compiled into a minimal acyclic
automaton that shares suffixes. A path's arc weights add up to the word's number, and the number finds its ids. The
automaton is one small file that Spark hands to every executor, where workers memory-map it. Words outside it are
merged exactly, so the lexicon decides on speed alone. Decoding looks up the bytes of every id.
"""

from __future__ import annotations

import hashlib
import mmap
import uuid
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_core import Vocabulary, vocabulary
from .common import cut, map_texts, releasing, shared_file, slices
from .token_counts import pre_tokens

#: The most words of the lexicon, which bounds the file (about 30 bytes a word) and the driver's share.
LEXICON_WORDS = 60_000
#: Words that a worker keeps in memory, twice: those seen since the last change of tables, and those before. About
#: 400 bytes a word; a pipeline's workers hold other stages' tables as well, so it uses fewer than a query of its own.
MEMO_WORDS, PIPELINE_MEMO_WORDS = 300_000, 20_000
#: Different words that a task counts before it hands their counts on.
COUNTED_WORDS = 60_000


def word_counts(docs: DataFrame, tokenizer: str, done: Callable[[], None] | None = None) -> DataFrame:
    """word, n over the pre-tokens of all texts (doc_id, text): counted within a task, then summed by word."""

    def run(batches):
        import pyarrow as pa

        vocab, counts = vocabulary(tokenizer), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for _, words, _ in pre_tokens(part.column("text").to_pylist(), vocab.specials):
                    counts.update(words)
                if len(counts) > COUNTED_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()

    return docs.select("text").mapInArrow(releasing(run, done), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_BYTES = [bytes([b]) for b in range(256)]

# ---- the automaton -------------------------------------------------------------------------------------------------


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """Minimal acyclic automaton of distinct words with their ids, as bytes: five int32 counts, then the arrays.

    Words are added in byte order; the part of the last word that the next one doesn't share is replaced by equal
    states already known, so equal suffixes are stored once. An arc's weight is the number of words that come before
    it in its state, so the weights along a path (with one for each final state passed) give the word's rank.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    known: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs_of: list[tuple] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(finals)
            finals.append(node[0])
            arcs_of.append(key[1])
        return known[key]

    path: list[list] = [[False, []]]
    before = b""
    for k in order:
        word = words[k]
        same = 0
        while same < min(len(before), len(word)) and before[same] == word[same]:
            same += 1
        while len(path) > same + 1:
            path[-2][1].append((before[len(path) - 2], settle(path[-1])))
            path.pop()
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        before = word
    while len(path) > 1:
        path[-2][1].append((before[len(path) - 2], settle(path[-1])))
        path.pop()
    root = settle(path[0])

    sizes = [0] * len(finals)
    first = np.zeros(len(finals) + 1, dtype="<i4")
    labels, targets, weights = [], [], []
    for s, arcs in enumerate(arcs_of):  # targets come before their sources
        total = int(finals[s])
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            weights.append(total)
            total += sizes[target]
        sizes[s] = total
        first[s + 1] = len(labels)
    flat = [ids[k] for k in order]
    bounds = np.cumsum([0, *map(len, flat)], dtype="<i4")
    head = np.array([len(finals), len(labels), len(order), bounds[-1], root], dtype="<i4")
    arrays = [head, first, np.array(targets, "<i4"), np.array(weights, "<i4"), bounds, np.array(list(chain.from_iterable(flat)), "<i4"), np.array(finals, "u1"), np.array(labels, "u1")]
    return b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Look-ups in a compiled automaton; the buffer stays mapped, nothing is unpacked."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        states, arcs, words, n_ids, self.root = np.frombuffer(view[:20], dtype="<i4").tolist()
        at = 20

        def take(n: int, kind: str, width: int):
            nonlocal at
            part = view[at : at + n * width].cast(kind)
            at += n * width
            return part

        self.first, self.targets, self.weights = take(states + 1, "i", 4), take(arcs, "i", 4), take(arcs, "i", 4)
        self.bounds, self.ids = take(words + 1, "i", 4), take(n_ids, "i", 4)
        self.finals, self.labels_at, self.buffer = take(states, "B", 1), at, buffer

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word of the lexicon, else None."""
        first, find, base = self.first, self.buffer.find, self.labels_at
        at, rank = self.root, 0
        for byte in word:
            arc = find(_BYTES[byte], base + first[at], base + first[at + 1]) - base
            if arc < 0:
                return None
            rank += self.weights[arc]
            at = self.targets[arc]
        if not self.finals[at]:
            return None
        return self.ids[self.bounds[rank] : self.bounds[rank + 1]].tolist()


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def build_lexicon(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS, done: Callable[[], None] | None = None) -> str:
    """Compile the corpus's most frequent words and give the file to all executors; returns its name.

    Words are grouped by the size of their counts, eight groups to a doubling; the groups with the largest counts
    whose words are no more than `words` together are in it.
    """
    spark = docs.sparkSession
    counts = cut(word_counts(docs, tokenizer, done)).withColumn("size", F.floor(F.log2("n") * 8))
    room, least = words, None
    for r in sorted(counts.groupBy("size").count().collect(), reverse=True):  # a few hundred groups at most
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    top = counts.where(F.col("size") >= least).collect() if least is not None else []
    vocab = vocabulary(tokenizer)
    distinct = [r.word.encode() for r in top]
    data = compile_lexicon(distinct, [vocab.merge(w) for w in distinct])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    shared_file(spark, name, data)
    return name


class _Words(dict):
    """The ids of words seen lately; or, with listed, the ids as decimal text, and in decoded the bytes that they decode
    to. The ids are from the lexicon, else merged; the bytes are those of the ids, not of the word."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon, memo: int, listed: bool):
        super().__init__()
        self.vocab, self.lexicon, self.memo, self.listed = vocab, lexicon, memo, listed
        self.decoded: dict[str, bytes] = {}
        self.older: tuple[dict, dict] = ({}, {})
        self.long: list[str] = []

    def age(self) -> None:
        """Between two texts: forget long words, and with full tables those that weren't used since they filled last."""
        for word in self.long:
            del self[word]
            self.decoded.pop(word, None)
        self.long.clear()
        if len(self) > self.memo:
            self.older = (dict(self), self.decoded)
            self.clear()
            self.decoded = {}

    def of(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join(map(str, ids)), b"".join(map(self.vocab.tokens.__getitem__, ids))

    def __missing__(self, word: str) -> str | list[int]:
        found = self.older[0].get(word)
        if found is None:
            raw = word.encode()
            found = self.lexicon.find(raw)
            if found is None:
                found = self.vocab.merge(raw)
            if self.listed:
                found, self.decoded[word] = self.of(found)
        elif self.listed:
            self.decoded[word] = self.older[1][word]
        if len(word) > 64:
            self.long.append(word)
        self[word] = found
        return found


@lru_cache(maxsize=2)
def _words(tokenizer: str, lexicon: str, memo: int, listed: bool) -> _Words:
    return _Words(vocabulary(tokenizer), _mapped(lexicon), memo, listed)


def _forget() -> None:
    """Free the tables of this worker."""
    _words.cache_clear()
    vocabulary.cache_clear()


def encoded_texts(texts: list[str | None], words: _Words, each: Callable, of: Callable) -> list[list]:
    """For each text what `each` makes of the pre-tokens of its pieces, and `of` of special strings, in order."""
    out: list[list] = [[] for _ in texts]
    last = -1
    for i, found, special in pre_tokens(texts, words.vocab.specials):
        if i != last:
            words.age()
            last = i
        out[i].append(each(found) if special < 0 else of(special))
    return out


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    """The text of ids, special ones included; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(vocab.tokens.__getitem__, ids)).decode("utf-8", errors="replace")


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, memo: int = MEMO_WORDS) -> DataFrame:
    """doc_id and ids (array of int) for each row of docs (doc_id, text); a null or empty text gives no ids. With a
    smaller memo than usual, workers free it and the vocabulary after each partition."""
    done = _forget if memo < MEMO_WORDS else None
    lexicon = lexicon or build_lexicon(docs, tokenizer, done=done)

    def run(rows: dict[str, list]) -> dict[str, list]:
        words = _words(tokenizer, lexicon, memo, False)
        found = encoded_texts(rows["text"], words, lambda own: list(chain.from_iterable(map(words.__getitem__, own))), lambda i: [i])
        return {"doc_id": rows["doc_id"], "ids": [list(chain.from_iterable(parts)) for parts in found]}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>", done=done)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text for each row of encoded (doc_id, ids); null ids give an empty text."""

    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(tokenizer)
        for batch in batches:
            texts = [decode_ids(ids or [], vocab) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs (doc_id, text).

    Encodes each whole text and decodes its ids. A null text counts as empty (no ids); repeated rows are worked on
    each; an empty table gives no rows; other columns are not read. Special strings in a text become their ids.
    """
    lexicon = lexicon or build_lexicon(docs, tokenizer)

    def run(rows: dict[str, list]) -> dict[str, list]:
        words = _words(tokenizer, lexicon, MEMO_WORDS, True)
        out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}

        def each(found: list[str]) -> tuple[str, bytes]:
            # The first look-up makes the entries that the second one needs.
            return ",".join(map(words.__getitem__, found)), b"".join(map(words.decoded.__getitem__, found))

        for parts in encoded_texts(rows["text"], words, each, lambda i: words.of([i])):
            listed = ",".join([x for x, _ in parts])
            out["n_tokens"].append(listed.count(",") + 1 if listed else 0)
            out["ids_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([x for _, x in parts]).decode("utf-8", errors="replace").encode()).hexdigest())
        return out

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

