"""Token counts by finite-state tokenizers.

Two deterministic transducers run one after the other. The first reads character classes and marks where
pre-tokens start; it runs over chunks of equal length at once: each chunk yields a map from start state to end
state, the maps compose by a parallel prefix scan, and a second run with the known start states writes the marks.
The second reads the bytes of a pre-token; each transition carries the change of the token count, so the count is
the sum along the path. It is determinised as it is used, and exact: a token ends a prefix's encoding only if it
and the token before it encode to themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .bpe_core import Vocabulary, letter_classes, vocabulary
from .common import map_texts

#: Characters of one chunk of the pre-token transducer.
CHUNK = 256
#: Entries that a worker keeps in each of its tables; a full table is emptied and grows anew.
TABLE_LIMIT = 600_000

# Input classes: what the split pattern tells apart. The letters are those of the English contractions.
OTHER, LETTER, NUMBER, BLANK, WHITE, APOSTROPHE, ENDING, NEEDS_E, NEEDS_L, E, BREAK = range(11)
# States: what token is open. BLANKS and WHITES are runs of two or more that end in a blank or in other white space.
NONE, LETTERS, NUMBERS, OTHERS, ONE_BLANK, BLANKS, ONE_WHITE, WHITES, QUOTE, QUOTE_RV, QUOTE_L = range(11)
N_CLASSES = N_STATES = 11


def _transition(state: int, kind: int) -> tuple[int, int]:
    """Next state, and marks: 1 if a token starts at this character, 2 if one starts at the one before it."""
    opens = {LETTER: LETTERS, ENDING: LETTERS, NEEDS_E: LETTERS, NEEDS_L: LETTERS, E: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, APOSTROPHE: QUOTE, BLANK: ONE_BLANK, WHITE: ONE_WHITE, BREAK: NONE}
    if state == QUOTE:
        if kind == ENDING:
            return NONE, 0
        if kind in (NEEDS_E, NEEDS_L):
            return (QUOTE_RV if kind == NEEDS_E else QUOTE_L), 0
        return (OTHERS, 0) if kind in (OTHER, APOSTROPHE) else (opens[kind], 1)
    if state in (QUOTE_RV, QUOTE_L):
        if kind == (E if state == QUOTE_RV else NEEDS_L):
            return NONE, 0
        after, marks = _transition(LETTERS, kind)
        return after, marks | 2
    if state in (ONE_BLANK, BLANKS, ONE_WHITE, WHITES) and kind in (BLANK, WHITE):
        return (BLANKS if kind == BLANK else WHITES), 0
    if state in (ONE_BLANK, BLANKS) and kind != BREAK:
        return (OTHERS if kind == APOSTROPHE else opens[kind]), 2 * (state == BLANKS)
    if state == WHITES and kind != BREAK:
        return opens[kind], 3
    if (state, kind) in ((NUMBERS, NUMBER), (OTHERS, OTHER), (OTHERS, APOSTROPHE)) or state == LETTERS and opens[kind] == LETTERS:
        return state, 0
    return opens[kind], 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, bytes, bytes]:
    """Class of each code point (and of the break, one past the last); next state and marks by state * 11 + class."""
    kinds = letter_classes()
    classes = np.array([OTHER, LETTER, NUMBER, WHITE], dtype=np.uint8)[np.append(kinds, 0)]
    for letters, kind in ((" ", BLANK), ("'", APOSTROPHE), ("stmd", ENDING), ("rv", NEEDS_E), ("l", NEEDS_L), ("e", E)):
        classes[[ord(c) for c in letters]] = kind
    classes[-1] = BREAK
    steps = [_transition(s, k) for s in range(N_STATES) for k in range(N_CLASSES)]
    pad = bytes(256 - len(steps))
    return classes, bytes(s * N_CLASSES for s, _ in steps) + pad, bytes(m for _, m in steps) + pad


def token_starts(points: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points (0x110000 breaks the text): one boolean for each."""
    classes, nexts, marks = _tables()
    n = len(points)
    chunks = max(1, -(-n // CHUNK))
    kinds = np.full(chunks * CHUNK, BREAK, dtype=np.uint8)
    kinds[:n] = classes[points]
    kinds = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)
    step = lambda at, table: np.frombuffer(at.tobytes().translate(table), dtype=np.uint8).reshape(at.shape)
    maps = np.repeat((np.arange(N_STATES, dtype=np.uint8) * N_CLASSES)[:, None], chunks, axis=1)
    for j in range(CHUNK):
        maps = step(maps + kinds[j], nexts)
    maps = maps // N_CLASSES
    width = 1
    while width < chunks:  # inclusive prefix scan: afterwards map i leads from the text's start to the end of chunk i
        maps = np.concatenate([maps[:, :width], np.take_along_axis(maps[:, width:], maps[:, :-width], axis=0)], axis=1)
        width *= 2
    state = np.zeros(chunks, dtype=np.uint8)
    state[1:] = maps[NONE, :-1] * N_CLASSES
    out = np.empty((CHUNK, chunks), dtype=np.uint8)
    for j in range(CHUNK):
        at = state + kinds[j]
        out[j] = step(at, marks)
        state = step(at, nexts)
    out = out.T.ravel()
    starts = (out & 1).astype(bool)
    starts[:-1] |= out[1:] >= 2
    return starts[:n]


class CountTransducer:
    """Bytes of a pre-token in, number of its BPE tokens out."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.prefixes = {t[:i] for t in vocab.ids for i in range(1, len(t) + 1)} | {b""}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state: the longest suffix that begins some token, and for the prefixes that end in it the last token and
        # the count, relative to the whole. That is all that later steps can ask for.
        start = (b"", (-1,), (0,))
        self.states, self.numbers = [start], {start: 0}
        self.steps: dict[int, int] = {}

    def _fit(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > TABLE_LIMIT:
                self.fits.clear()
            found = self.fits[(a, b)] = self.vocab.fits(a, b)
        return found

    def _step(self, number: int, byte: int) -> int:
        """A new transition: next state * 256 + change of the count + 128."""
        suffix, lasts, counts = self.states[number]
        suffix += bytes([byte])
        while suffix not in self.prefixes:
            suffix = suffix[1:]
        for length in range(len(suffix), 0, -1):
            token = self.vocab.ids.get(suffix[-length:])
            if token is not None and length <= len(lasts) and (lasts[-length] < 0 or self._fit(lasts[-length], token)):
                break
        else:
            raise ValueError("no token fits")
        count = counts[-length] + 1
        keep = len(suffix) + 1
        state = (suffix, (*lasts, token)[-keep:], tuple(c - count for c in (*counts, count)[-keep:]))
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        found = self.steps[number << 8 | byte] = to << 8 | count + 128
        return found

    def count(self, word: bytes) -> int:
        if len(self.steps) > TABLE_LIMIT:
            self.reset()
        at, total, steps = 0, 0, self.steps
        for byte in word:
            found = steps.get(at << 8 | byte)
            if found is None:
                found = self._step(at, byte)
            at = found >> 8
            total += (found & 255) - 128
        return total


class _Memo(dict):
    """Counts of the pre-tokens seen lately."""

    def __init__(self, transducer: CountTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        n = self.transducer.count(word.encode())
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _memo(path: str) -> _Memo:
    return _Memo(CountTransducer(vocabulary(path)))


def pre_tokens(texts: list[str | None], specials: dict[str, int]) -> Iterator[tuple[int, list[str], int]]:
    """Place of a text, pre-tokens, and -1; or place, no pre-tokens and the id of a special string, which splits its
    text. All texts go through the transducer at once; the pieces of a text come in order, empty ones are left out."""
    pieces: list[tuple[int, str, int]] = []
    for i, text in enumerate(texts):
        parts = [(text or "", -1)]
        for special, number in specials.items():
            if special in parts[0][0] or len(parts) > 1:
                parts = [x for part, own in parts for x in ([(part, own)] if own >= 0 else _cut_at(part, special, number))]
        pieces += [(i, part, own) for part, own in parts if part]
    plain = [part for _, part, own in pieces if own < 0]
    if plain:
        lengths = np.array([len(p) + 1 for p in plain])
        ends = np.cumsum(lengths)
        points = np.frombuffer("\n".join([*plain, ""]).encode("utf-32-le"), dtype="<u4").copy()
        points[ends - 1] = 0x110000
        starts = np.flatnonzero(token_starts(points))
        firsts, lasts = np.searchsorted(starts, ends - lengths).tolist(), np.searchsorted(starts, ends - 1).tolist()
        bases = (ends - lengths).tolist()
    k = 0
    for i, part, own in pieces:
        if own >= 0:
            yield i, [], own
            continue
        at = (starts[firsts[k] : lasts[k]] - bases[k]).tolist()
        at.append(len(part))
        yield i, [part[a:b] for a, b in zip(at, at[1:])], -1  # noqa: B905
        k += 1


def _cut_at(part: str, special: str, number: int) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for k, x in enumerate(part.split(special)):
        out += [(special, number)] * (k > 0) + [(x, -1)]
    return out


def count_batch(texts: list[str | None], path: str) -> list[int]:
    """Token counts of texts; special strings inside a text count as one token and split it."""
    memo = _memo(path)
    if len(memo) > TABLE_LIMIT:
        memo.clear()
    counts = [0] * len(texts)
    for i, words, special in pre_tokens(texts, memo.transducer.vocab.specials):
        counts[i] += sum(map(memo.__getitem__, words)) if special < 0 else 1
    return counts


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than limit) for each row of docs (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table gives no rows;
    other columns are not read. Texts of any length are read whole.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        n = count_batch(rows["text"], tokenizer)
        return {"doc_id": rows["doc_id"], "n_bytes": [len((t or "").encode()) for t in rows["text"]], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
