"""Which images are linked by agreeing corners: their features in blocks, of which each two meet in one task.

Features meet where a 32-bit segment of their descriptors is equal, however many do, and all close ones of two images are
counted there and then. Only images with MIN_VOTES of them vote, so that matches of common shapes, whose number grows with
the square of the images, never leave their task, and neither do links: a task gives the number of links of each image and
the smallest image that they reach, which is a row for each linked image, however large a group of copies is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, stored
from .media import CELL, MAX_BITS, MIN_VOTES, TURNS

#: Features of a block (48 bytes each); of small tables in up to SPREAD blocks, LEAST_FEATURES each at least. A block travels
#: in rows of PIECE bytes.
BLOCK_FEATURES, SPREAD, LEAST_FEATURES, PIECE = 1 << 19, 12, 1 << 16, 1 << 17
#: Close pairs that a task holds at once: if two blocks have more, fewer of their images are compared at a time.
HELD = 1 << 21
#: Pairs that are compared at once; runs of equal segments with as many pairs as WIDE are compared as a whole.
AT_ONCE, WIDE = 1 << 18, 1 << 13
_COUNTS = 21
#: Pieces are stored as they are and in pages of a few, as buffers for larger ones stay outside of the heap until it is cleaned. A
#: block is a file with one row group, so that it is read in one task, whatever the files are cut at.
_PLAIN = {"compression": "none", "parquet.block.size": str(2000 << 20), "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_PIECES = "block long, pos int, n int, piece binary"
_LINKED = "node long, root long, n long"


def _flat(rows: DataFrame) -> DataFrame:
    """media_id and features (media_id, features) as bytes, 32 for each feature."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            lists = batch.column("features")
            own = lists.flatten()
            columns = [own.field(name).to_numpy(zero_copy_only=False) for name in ("x", "y", "scale", "turn", "d0", "d1", "d2", "d3")]
            data = np.stack([c.astype(np.float32).view(np.int32) for c in columns[:4]] + [c.astype(np.int32) for c in columns[4:]], axis=1) if len(own) else np.zeros((0, 8), np.int32)
            ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]) * 32
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), pa.array([raw[i:k] for i, k in zip(ends, ends[1:], strict=False)], pa.binary())], ["media_id", "data"])

    return rows.mapInArrow(releasing(run), "media_id long, data binary")


def _pack(table, size: int):
    """A block in pieces of some bytes: how many images and features it has, the images' ids in order, where each one's features
    start, these, and their orders by each segment."""
    import pyarrow as pa

    ids = table.column("media_id").to_numpy()
    by = np.argsort(ids)
    data = table.column("data").to_pylist()
    features = np.frombuffer(b"".join(data[i] for i in by), np.int32).reshape(-1, 8)
    starts = np.cumsum([0, *(len(data[i]) // 32 for i in by)])
    raw = memoryview(packed(ids[by], starts, features))
    pieces = [raw[i : i + size] for i in range(0, len(raw), size)]
    n = len(pieces)
    columns = [pa.array([table.column("block")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(pieces, pa.binary())]
    return pa.table(columns, ["block", "pos", "n", "piece"])


def packed(ids: np.ndarray, starts: np.ndarray, features: np.ndarray) -> bytes:
    """Bytes of a block: ids of images in order, where their features start, and these (place and bits, 32-bit numbers)."""
    orders = [np.argsort(features[:, 4 + t], kind="stable").astype(np.int32) for t in range(4)]
    head = np.array([len(ids), len(features)])
    return b"".join(x.tobytes() for x in (head, ids.astype(np.int64), starts.astype(np.int64), features, *orders))


class _Block:
    def __init__(self, raw: bytes) -> None:
        images, n = np.frombuffer(raw, np.int64, 2).tolist()
        self.ids = np.frombuffer(raw, np.int64, images, 16)
        self.starts = np.frombuffer(raw, np.int64, images + 1, 16 + 8 * images)
        at = 24 + 16 * images
        rows = np.frombuffer(raw, np.int32, 8 * n, at).reshape(-1, 8)
        self.place, self.bits = rows[:, :4].view(np.float32), rows[:, 4:]
        self.words = np.ascontiguousarray(self.bits).view(np.uint64)
        self.orders = np.frombuffer(raw, np.int32, 4 * n, at + 32 * n).reshape(4, -1)
        self.image = np.repeat(np.arange(images, dtype=np.int32), np.diff(self.starts))

    def ordered(self, t: int, images: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Features of some images by their segment t, their words, where each segment's run starts and its value."""
        order = self.orders[t]
        if len(images) < len(self.ids):
            order = order[(order >= self.starts[images.start]) & (order < self.starts[images.stop])]
        value = self.bits[order, t]
        runs = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        return order, self.words[order].T.copy(), np.append(runs, len(value)), value[runs]


def _close(a: _Block, b: _Block, some: range, others: range) -> tuple[np.ndarray, np.ndarray] | None:
    """Close features of some images of a and others of b that have a segment in common, each pair once; None if they are more
    than HELD. With the same images on both sides, the first of a pair is of the earlier image."""
    same = a is b and some == others
    found, held = [], 0

    def keep(t: int, i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        new = np.ones(len(i), bool)
        for u in range(t):  # met at an earlier segment
            new &= a.bits[i, u] != b.bits[j, u]
        if a is b:
            new &= a.image[i] < a.image[j] if same else a.image[i] != a.image[j]
        found.append((i[new], j[new]))
        held += int(new.sum())

    for t in range(4):
        order_a, words_a, runs_a, values_a = a.ordered(t, some)
        order_b, words_b, runs_b, values_b = (order_a, words_a, runs_a, values_a) if same else b.ordered(t, others)
        if not len(values_a) or not len(values_b):
            break
        at = np.minimum(np.searchsorted(values_b, values_a), len(values_b) - 1)
        k = np.flatnonzero(values_b[at] == values_a)
        at = at[k]
        first_a, n_a, first_b, n_b = runs_a[k], runs_a[k + 1] - runs_a[k], runs_b[at], runs_b[at + 1] - runs_b[at]
        wide = n_a * n_b >= WIDE
        for p, m, q, n in zip(*(x[wide].tolist() for x in (first_a, n_a, first_b, n_b)), strict=True):
            step = max(1, AT_ONCE // n)
            for r in range(p, p + m, step):
                rows, columns = slice(r, min(r + step, p + m)), slice(r + 1 if same else q, q + n)
                far = np.bitwise_count(words_a[0, rows, None] ^ words_b[0, None, columns]) + np.bitwise_count(words_a[1, rows, None] ^ words_b[1, None, columns])
                i, j = np.nonzero(far <= MAX_BITS)
                i, j = i + r, j + columns.start
                if same:
                    i, j = i[i < j], j[i < j]
                keep(t, order_a[i], order_b[j])
                if held > HELD and len(some) * len(others) > 1:
                    return None
        rest = ~wide & (n_a * n_b > same)
        first_a, n_a, first_b, n_b = (x[rest] for x in (first_a, n_a, first_b, n_b))
        ends = np.cumsum(n_a)
        row = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first_a - (ends - n_a), n_a)
        to, n = np.repeat(first_b, n_a), np.repeat(n_b, n_a)
        if same:
            n, to = to + n - row - 1, row + 1
        ends = np.cumsum(n)
        cuts = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1] if len(ends) else 0, AT_ONCE))
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):
            own = n[s:e]
            i = np.repeat(row[s:e], own)
            j = np.arange(len(i)) + np.repeat(to[s:e] - (np.cumsum(own) - own), own)
            far = np.bitwise_count(words_a[0, i] ^ words_b[0, j]) + np.bitwise_count(words_a[1, i] ^ words_b[1, j])
            near = far <= MAX_BITS
            keep(t, order_a[i[near]], order_b[j[near]])
            if held > HELD and len(some) * len(others) > 1:
                return None
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (zip(*found, strict=True) if found else ((), ())))


def _enough(key: np.ndarray) -> np.ndarray:
    """Which of some keys are there MIN_VOTES times or more."""
    cell = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _COUNTS)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(cell, minlength=1 << _COUNTS)[cell] >= MIN_VOTES)
    _, back, n = np.unique(key[maybe], return_inverse=True, return_counts=True)
    return maybe[n[back] >= MIN_VOTES]


def _agreeing(p: np.ndarray, q: np.ndarray, place_p: np.ndarray, place_q: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The pairs of images of which MIN_VOTES distinct features p and as many q agree on one turn, scale and shift, as
    media._agreed() has it."""
    turn = np.fmod((place_q[:, 3] - place_p[:, 3]).astype(np.float64), 2 * np.pi)
    turn = np.where(turn < 0, np.fmod(turn + 2 * np.pi, 2 * np.pi), turn)
    zoom = np.rint(np.log2(place_q[:, 2].astype(np.float64) / place_p[:, 2]))
    low = zoom.min(initial=0)
    done = []
    for t in (0, 1):
        turns = np.floor(turn * TURNS / (2 * np.pi) + 0.5 * t).astype(np.int64) % TURNS
        left = np.arange(len(pair))
        if done:
            left = left[~np.isin(pair, np.concatenate(done))]
        key = (pair[left] * 256 + (zoom[left] - low).astype(np.int64)) * TURNS + turns[left]
        k = left[_enough(key)]
        # All matches of a cell are turned by the cell's own angle, so that a small error moves near corners alike.
        angle = [(c + 0.5 - 0.5 * t) * (2 * np.pi / TURNS) for c in range(TURNS)]
        cos, sin = np.array([math.cos(x) for x in angle])[turns[k]], np.array([math.sin(x) for x in angle])[turns[k]]
        size = np.exp2(zoom[k])
        px, py, qx, qy = (c.astype(np.float64) for c in (*place_p[k, :2].T, *place_q[k, :2].T))
        span = CELL * np.maximum(size, 1.0) * 2
        x, y = (qx - size * (cos * px - sin * py)) / span, (qy - size * (sin * px + cos * py)) / span
        for gx in (0, 1):
            for gy in (0, 1):
                cell = [np.floor(y + 0.5 * gy), np.floor(x + 0.5 * gx), zoom[k], turns[k], pair[k]]
                by = np.lexsort(cell)
                starts = np.append(True, np.any([c[by][1:] != c[by][:-1] for c in cell], axis=0)) if len(by) else np.zeros(0, bool)
                group = np.cumsum(starts) - 1
                n = np.bincount(group) >= MIN_VOTES
                group, by = group[n[group]], by[n[group]]
                for side in (p, q):
                    seen = np.unique(np.stack([group, side[k[by]].astype(np.int64)]), axis=1)[0]
                    ok = np.isin(group, np.flatnonzero(np.bincount(seen) >= MIN_VOTES))
                    group, by = group[ok], by[ok]
                done.append(np.unique(pair[k[by]]))
    return np.unique(np.concatenate(done))


def _linked(a: _Block, b: _Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked images, as numbers in a and in b, of two blocks or of one block and itself; each pair comes once."""
    parts = [(range(len(a.ids)), range(len(b.ids)))]
    while parts:
        some, others = parts.pop()
        close = _close(a, b, some, others)
        if close is None:
            same, wider = a is b and some == others, len(some) >= len(others)
            halves = lambda x: [x[: len(x) // 2], x[len(x) // 2 :]]
            one, two = halves(some if wider else others)
            parts += [(one, one), (one, two), (two, two)] if same else [(h, others) if wider else (some, h) for h in (one, two)]
            continue
        i, j = close
        pair = a.image[i].astype(np.int64) * len(b.ids) + b.image[j]
        k = _enough(pair)
        if not len(k):
            continue
        i, j, pair = i[k], j[k], pair[k]
        turned = (a.ids[a.image[i]] > b.ids[b.image[j]])[:, None]  # a match goes from the smaller id to the larger
        place_i, place_j = a.place[i], b.place[j]
        linked = _agreeing(i, j, np.where(turned, place_j, place_i), np.where(turned, place_i, place_j), pair)
        yield linked // len(b.ids), linked % len(b.ids)


def _summed(a: _Block, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, root and n: linked images of two blocks, the smallest image that these links reach, the number of links of each."""
    ids = a.ids if a is b else np.sort(np.concatenate([a.ids, b.ids]))
    at_a, at_b = np.searchsorted(ids, a.ids), np.searchsorted(ids, b.ids)
    n, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j in _linked(a, b):
        u, v = at_a[i], at_b[j]
        n += np.bincount(u, minlength=len(ids)) + np.bincount(v, minlength=len(ids))
        while (root[u] != root[v]).any():
            x, y = root[u], root[v]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    k = np.flatnonzero(n)
    return ids[k], ids[root[k]], n[k]


def linked(rows: DataFrame, features: int) -> DataFrame:
    """node, root and n of each linked image of rows (media_id, features: as media.described() has them; ids once each), in one
    row or several: n is a part of its number of links, root an image that it is linked with over others, or itself.

    features: how many the rows have, about.
    """
    import pyarrow as pa

    blocks = max(-(-features // BLOCK_FEATURES), min(SPREAD, -(-features // LEAST_FEATURES)), 1)
    size = PIECE
    pieces = stored(_flat(rows).withColumn("block", F.pmod(F.xxhash64("media_id"), F.lit(blocks))).groupBy("block").applyInArrow(lambda table: _pack(table, size), _PIECES), ("block",), **_PLAIN)
    # Of two blocks, the one meets the other if it comes within half a round after it, so each has as many to meet.
    ahead = F.pmod(F.col("b.block") - F.col("a.block"), F.lit(blocks))
    meets = (2 * ahead < blocks) | (2 * ahead == blocks) & (F.col("a.block") < F.col("b.block"))
    # Each piece of the one comes with the first piece of the other.
    first = (F.col("a.pos") == 0) | (F.col("b.pos") == 0)
    both = pieces.alias("a").join(pieces.alias("b").hint("shuffle_replicate_nl"), meets & first)
    own = lambda s, t: [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("block", "pos", "n")] + [F.when(F.col(f"{t}.pos") == 0, F.col(f"{s}.piece")).alias(f"piece_{s}")]

    def run(batches):
        pairs, held, whole = {}, {}, {}
        for batch in batches:
            for r in batch.to_pylist():
                pairs[r["block_a"], r["block_b"]] = None
                for side in "ab":
                    if r[f"piece_{side}"] is not None:
                        held.setdefault(r[f"block_{side}"], {})[r[f"pos_{side}"]] = r[f"piece_{side}"]
                        whole[r[f"block_{side}"]] = r[f"n_{side}"]
        if any(len(held[k]) < n for k, n in whole.items()):
            raise ValueError("a block's pieces are in several partitions")
        raw = {k: b"".join(p[i] for i in range(n)) for k, n in whole.items() for p in [held.pop(k)]}
        last, a = None, None
        for one, two in sorted(pairs):
            a = a if one == last else _Block(raw[one])
            last = one
            node, root, n = _summed(a, a if two == one else _Block(raw[two]))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(n)], ["node", "root", "n"])

    return stored(both.select(*own("a", "b"), *own("b", "a")).mapInArrow(releasing(run), _LINKED))
