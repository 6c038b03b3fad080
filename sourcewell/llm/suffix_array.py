"""Suffix arrays, common prefixes and repeated windows of one shard of bytes, in numpy."""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + n]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by Larsson-Sadakane refinement.

    Groups of suffixes that agree on h bytes are sorted by the groups h bytes further on; h doubles until every group
    is one suffix; groups of one are left alone from then on. A group's number is where it starts in the order. Sorts
    double their depth, so even a text of one repeated byte takes no more than log2(n) of them.
    """
    n = len(text)
    first = words8(text)[::-1]
    order = n - 1 - np.argsort(first, kind="stable")  # of suffixes with equal padded words, shorter ones come first
    key = words8(text)[order]
    short = order > n - 8  # no other suffix agrees with such a one on eight bytes
    fresh = np.append(True, (key[1:] != key[:-1]) | short[:-1])[:n]
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, n))
    group = np.full(n + 1, -1, np.int64)
    group[order] = np.repeat(heads, sizes)
    open_at = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 8
    while len(open_at):
        at = order[open_at]
        key = group[at] << 32 | (group[at + h] + 1)
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[open_at] = at
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        group[at] = np.repeat(open_at[heads], sizes)
        open_at = open_at[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """For each place of the order the bytes, up to cap, shared with the place before, by Kasai's method.

    order must be the order of the whole suffixes: only then does what a suffix shares carry over to the next one.

    From one text position to the next the shared length falls by one at most, so each walk goes on where the last
    one ended. Many stretches of the text are walked at once, eight bytes a step.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eight = np.append(words8(text), np.zeros(cap + 8, np.uint64))
    span = -(-n // lanes)
    starts = np.arange(0, n, span)
    have = np.zeros(len(starts), np.int64)
    limits = np.array([1 << (8 * k) for k in range(8)], np.uint64)
    for step in range(span):
        at = starts + step
        live = np.flatnonzero(at < n)
        live = live[before[at[live]] >= 0]
        have = np.maximum(have - 1, 0)
        dead = np.ones(len(have), bool)
        dead[live] = False
        have[dead] = 0
        going = live
        while len(going):
            i, j, h = at[going], before[at[going]], have[going]
            differ = eight[i + h] ^ eight[j + h]
            same = 8 - np.searchsorted(limits, differ, side="right")
            room = np.minimum(cap, n - np.maximum(i, j)) - h
            have[going] = h + np.minimum(same, room)
            going = going[(same == 8) & (room > 8)]
        out[at[live]] = have[live]
    return out[order]


def repeated_windows(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each position: is it marked in starts, and do the same `width` bytes begin at another marked one too?"""
    if not len(text):
        return np.zeros(0, bool)
    order = suffix_array(text)
    classes = np.cumsum(common_prefixes(text, order, width) < width)
    marked = starts[order]
    counts = np.bincount(classes[marked], minlength=classes[-1] + 1)
    out = np.zeros(len(text), bool)
    out[order] = marked & (counts[classes] > 1)
    return out
