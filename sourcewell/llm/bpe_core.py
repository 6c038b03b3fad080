"""Byte-level BPE shared by token counting and encoding: vocabulary file, exact merges, pre-token classes."""

from __future__ import annotations

import heapq
import json
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np

#: Stands for a pair that doesn't merge; above all ranks.
_NONE = (1 << 60, -1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, by its published rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of one byte-level BPE file in the tokenizers JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        letters = byte_alphabet()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.tokens: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.byte_ids = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.specials.items():
            self.tokens[i] = content.encode()

    @cached_property
    def edges(self) -> dict[int, tuple[list, list]]:
        """For each token the chain of its parts at its left and right edge, smallest first, each with the rank of the
        merge that takes it up (never, for the token itself)."""
        halves = {new: (a, b, rank) for (a, b), (rank, new) in self.merges.items()}
        never, out = len(self.merges), {}
        for token in self.ids.values():
            chains = []
            for side in (0, 1):
                chain, at, rank = [], token, never
                while True:
                    chain.append((at, rank))
                    if at not in halves:
                        break
                    rank, at = halves[at][2], halves[at][side]
                chains.append(chain[::-1])
            out[token] = (chains[0], chains[1])
        return out

    def fits(self, a: int, b: int) -> bool:
        """True if merging the joined bytes of two tokens gives the two again: no merge ever crosses their border."""
        lefts, rights, merges = self.edges[a][1], self.edges[b][0], self.merges
        never, i, j = len(merges), 0, 0
        while True:
            (x, x_goes), (y, y_goes) = lefts[i], rights[j]
            crossing = merges.get((x, y))
            if crossing and crossing[0] < x_goes and crossing[0] <= y_goes:
                return False
            if x_goes == y_goes == never:
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token by exact merging: lowest rank first, leftmost among equals; n log n in its length."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        if n <= 24:
            get = merges.get
            found = list(map(get, zip(ids, ids[1:]), repeat(_NONE)))  # noqa: B905
            while found and (best := min(found)) is not _NONE:
                i, new = found.index(best), best[1]
                ids[i : i + 2] = [new]
                del found[i]
                if i:
                    found[i - 1] = get((ids[i - 1], new), _NONE)
                if i < len(found):
                    found[i] = get((new, ids[i + 1]), _NONE)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in merges]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b or before[j] != i:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1], new, ids[k]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1], ids[h], new))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and path."""
    return Vocabulary(path)


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 number, 3 white space; built from the Unicode properties."""
    import regex

    kinds = np.zeros(0x110000, dtype=np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[points[m.start() : m.end()]] = kind
    return kinds
