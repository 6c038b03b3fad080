"""Cropped and edited copies of images by local descriptors.

Images are a binary column in the portable graymap format (P5). On several scales, corners are found where the image
changes in two directions; each gets an orientation from its surroundings' centre of intensity, and DESCRIPTOR binary
tests of pairs of points turned to it. Descriptors meet where one of their 32-bit segments is equal, however many do.
Matches within MAX_BITS vote for a turn, a scale and a shift; images are linked if enough distinct corners agree. Equal
images are one node from the start. copies() finds all links by blocks of images: see image_links.

links() finds the same links by tables of segments, as pairs of features that are joined; tests hold the two against each
other. Where more than PAIRED meet at a table's place, each first meets the first of its place and its neighbours, which
joins copies; then all that no class joins yet are compared in blocks, so no match of a place is lost that could join two
classes, but links within such a class aren't all there. Matches are first counted, in cells by a hash of the two images;
only those of cells with MIN_VOTES or more become pairs. Cells hold no fewer than their images' matches, so no pair of
images that could be linked is ruled out, but they fill with the square of the images.

This is an index: two descriptors without an equal segment don't meet, but two images have many corners in common and
need no more than MIN_VOTES matches. README has the recall of links against brute force over all descriptors.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, map_texts, maybe_in, releasing, small_batches, stored
from .components import components

DESCRIPTOR, MAX_BITS = 128, 12
#: Corners kept for each scale (halving the image each time) in each AREA pixels of the image: those with the strongest
#: response. A larger image keeps more, so that its crops share them.
CORNERS, AREA = (28, 14, 8), 96 * 96
#: Agreeing corners that link two images; descriptors of a table's place that are all paired at once.
MIN_VOTES, PAIRED = 4, 1024
#: Neighbours that a descriptor of a crowded place meets on either side before classes are known; features of a part of
#: such a place that meets another part in one group.
NEIGHBOURS, BLOCK = 4, 4096
#: Bits of the number of cells in which matches are counted by pairs of images, before any pair is made; features of a
#: place beyond which its matches aren't counted: images that have some there are open, and two open ones are never ruled out.
CELL_BITS, COUNTED = 25, 4096
_BLOCK_BITS = 16
#: Votes are counted in cells of this many pixels and this part of a turn, on two grids half a cell apart.
CELL, TURNS = 8.0, 24
_BORDER = 13
#: Bits of a feature's number in its id: enough for 300 million pixels.
FID_BITS = 21

_FEATURE = "struct<x:float,y:float,scale:float,turn:float,d0:int,d1:int,d2:int,d3:int>"


def decode(data: bytes | None) -> np.ndarray | None:
    """Pixels of a P5 graymap of at most 8 bits; None if it is none."""
    parts = (data or b"").split(maxsplit=4)
    if len(parts) < 4 or parts[0] != b"P5" or not all(p.isdigit() for p in parts[1:4]):
        return None
    w, h, top = map(int, parts[1:4])
    head = len(parts[0])
    for p in parts[1:4]:
        head = data.index(p, head) + len(p)
    pixels = np.frombuffer(data[head + 1 :], np.uint8)
    return pixels[: w * h].reshape(h, w).astype(np.float32) if 0 < top < 256 and len(pixels) >= w * h > 0 else None


def encode(pixels: np.ndarray) -> bytes:
    """A P5 graymap of pixels from 0 to 255."""
    h, w = pixels.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


@lru_cache(maxsize=1)
def _tests() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the surroundings, and of both points of each binary test, as complex numbers."""
    rng = np.random.default_rng(128)
    y, x = np.mgrid[-7:8, -7:8]
    disc = (x + 1j * y)[x * x + y * y <= 49]
    points = np.clip(rng.normal(0, 4.5, (4, DESCRIPTOR)), -8.5, 8.5)
    return disc, np.stack([points[0] + 1j * points[1], points[2] + 1j * points[3]])


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean of the square of 2 r + 1 by 2 r + 1 around each value but the outer r. Sums of pixels and of their products are exact."""
    k = 2 * r + 1
    rows = a[: 1 - k] + a[1 : 2 - k]
    for i in range(2, k):
        rows += a[i : i + 1 - k or None]
    out = rows[:, : 1 - k] + rows[:, 1 : 2 - k]
    for i in range(2, k):
        out += rows[:, i : i + 1 - k or None]
    out /= k**2
    return out


def _corners(image: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    edge = _BORDER - 4  # what lies further out is in no surroundings of a corner
    own = image[edge : image.shape[0] - edge, edge : image.shape[1] - edge]
    gx, gy = own[1:-1, 2:] - own[1:-1, :-2], own[2:, 1:-1] - own[:-2, 1:-1]
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = response[1:-1, 1:-1]
    around = np.maximum(np.maximum(response[:-2], response[1:-1]), response[2:])
    around = np.maximum(np.maximum(around[:, :-2], around[:, 1:-1]), around[:, 2:])
    y, x = np.nonzero((inner > 50.0) & (inner >= around))
    best = np.argsort(-inner[y, x], kind="stable")[:most]
    return x[best] + _BORDER, y[best] + _BORDER


def describe(pixels: np.ndarray) -> list[tuple[float, float, float, float, list[int]]]:
    """x, y (in the image's own pixels), scale, turn and descriptor (four signed 32-bit numbers) of its corners."""
    disc, tests = _tests()
    image, scale = pixels.astype(np.float64), 1.0
    out = []
    share = max(1.0, image.size / AREA)
    for most in (int(n * share) for n in CORNERS):
        if min(image.shape) < 2 * _BORDER + 2:
            break
        x, y = _corners(image, most)
        if len(x):
            smooth = _box(image, 1)  # smooth[y, x] is around (y + 1, x + 1)
            at = x + 1j * y
            around = at[:, None] + disc
            values = smooth[around.imag.astype(int) - 1, around.real.astype(int) - 1]
            turn = np.angle((values * disc).sum(1))
            points = at[:, None, None] + tests * np.exp(1j * turn)[:, None, None]
            read = smooth[np.rint(points.imag).astype(int) - 1, np.rint(points.real).astype(int) - 1]
            bits = np.packbits(read[:, 0] < read[:, 1] - 0.5, axis=1).view(">i4")
            where = (at + 0.5 + 0.5j) * scale - (0.5 + 0.5j)
            out += [(p.real, p.imag, scale, t, d) for p, t, d in zip(where.tolist(), turn.tolist(), bits.tolist(), strict=True)]
        h, w = (n // 2 * 2 for n in image.shape)
        image = (image[:h:2, :w:2] + image[:h:2, 1:w:2] + image[1:h:2, :w:2] + image[1:h:2, 1:w:2]) / 4
        scale *= 2
    return out


def described(media: DataFrame) -> DataFrame:
    """media_id, image (hash of the bytes, null for null) and features of each row of media (media_id, data)."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        import xxhash

        out: dict[str, list] = {"media_id": rows["media_id"], "image": [], "features": []}
        for data in rows["data"]:
            pixels = decode(data)
            found = describe(pixels) if pixels is not None else []
            out["image"].append(None if data is None else xxhash.xxh3_128_hexdigest(data))
            out["features"].append([{"x": x, "y": y, "scale": s, "turn": t, "d0": d[0], "d1": d[1], "d2": d[2], "d3": d[3]} for x, y, s, t, d in found])
        return out

    return map_texts(media, run, f"media_id long, image string, features array<{_FEATURE}>", "data")


def _image(fid):
    return F.shiftright(fid, FID_BITS)


_BITS = ("d0", "d1", "d2", "d3")


def _entries(found: DataFrame) -> DataFrame:
    """place (table and segment), fid, left and right (the other three segments) of each feature (fid, d0..d3), four times."""
    joint = lambda high, low: f"shiftleft(cast({high} as bigint), 32) | (cast({low} as bigint) & 4294967295L)"
    others = lambda t: [f"d{u}" for u in range(4) if u != t]
    each = (f"struct({joint(t, f'd{t}')} as place, {joint(*others(t)[:2])} as left, cast({others(t)[2]} as bigint) & 4294967295L as right)" for t in range(4))
    return found.select("fid", F.explode(F.expr(f"array({', '.join(each)})")).alias("e")).select("e.place", "fid", "e.left", "e.right")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of some pairs (rows: fid, left, right) of one place are close and of two images."""
    bits = np.bitwise_count((x[1] ^ y[1]).view(np.uint64)) + np.bitwise_count((x[2] ^ y[2]).view(np.uint64))
    return (bits <= MAX_BITS) & (x[0] >> FID_BITS != y[0] >> FID_BITS)


def _met(found: DataFrame) -> DataFrame:
    """place, fid, left, right, n and pos (number of features at the place, and which one it is) of the features that
    meet others, each place's in a row."""
    order = Window.partitionBy("place").orderBy("fid")
    n = F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n")
    return _entries(found).select("place", "fid", "left", "right", n, F.row_number().over(order).alias("pos")).where("n > 1").sortWithinPartitions("place", "fid")


def _columns(batch) -> np.ndarray:
    """fid, left, right, n, pos and the table's number as rows."""
    own = [batch.column(c).to_numpy().astype(np.int64) for c in ("fid", "left", "right", "n", "pos", "place")]
    return np.stack([*own[:5], own[5] >> 32])


def _cell(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The cell of the images of features p and q."""
    a, b = (f(p, q).astype(np.int64).view(np.uint64) >> np.uint64(FID_BITS) for f in (np.minimum, np.maximum))
    h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9FB21C651E98DF25)
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _earlier(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of features that meet (rows as _columns() has them) also meet in an earlier table."""
    left, right, t = (x[1] ^ y[1]).view(np.uint64), x[2] ^ y[2], x[5]
    return (t >= 1) & (left >> np.uint64(32) == 0) | (t >= 2) & (left & np.uint64(0xFFFFFFFF) == 0) | (t == 3) & (right == 0)


def _plenty(found: DataFrame) -> np.ndarray:
    """Bits of the cells of images that may have MIN_VOTES matches, and those of open images with themselves."""
    import pyarrow as pa

    def count(batches):
        cells = np.zeros(1 << CELL_BITS, np.uint8)
        last = np.zeros((6, 0), np.int64)
        for batch in batches:
            x = np.concatenate([last, _columns(batch)], axis=1)
            first, counted, hits = last.shape[1], x[3] <= COUNTED, []
            j = first + np.flatnonzero(counted[first:])
            for step in range(1, COUNTED):
                j = j[x[4, j] > step]
                if not len(j):
                    break
                a, b = x[:, j - step], x[:, j]
                near = _near(a[:3], b[:3]) & ~_earlier(a, b)
                hits.append(_cell(a[0, near], b[0, near]))
            if hits:
                at, n = np.unique(np.concatenate(hits), return_counts=True)
                cells[at] = np.minimum(cells[at] + n, MIN_VOTES)
            wide = x[0, first:][~counted[first:]]
            cells[_cell(wide, wide)] = MIN_VOTES
            last = x[:, -COUNTED:]
        at = np.flatnonzero(cells)
        block = at >> _BLOCK_BITS
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        own = [(int(block[i]), at[i:k].astype(np.uint16).tobytes(), cells[at[i:k]].tobytes()) for i, k in zip(begin, [*begin[1:], len(at)], strict=True)]
        for row in own:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        cells = np.zeros(1 << _BLOCK_BITS, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            cells[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint8)
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(cells >= MIN_VOTES, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((1 << CELL_BITS - _BLOCK_BITS, 1 << _BLOCK_BITS - 3), np.uint8)
    counted = _met(found).mapInArrow(releasing(count), "block int, at binary, n binary")
    for r in counted.groupBy("block").applyInArrow(add, "block int, bits binary").collect():  # 4 MB, whatever the input
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


class _Counted(NamedTuple):
    """Features with what _plenty() says of them."""

    found: DataFrame
    plenty: Broadcast


def _may_link(plenty: Broadcast | None, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which features p and q are of images that may have MIN_VOTES matches; all, without counts."""
    if plenty is None:
        return np.ones(len(q), bool)
    has = lambda cell: plenty.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1
    return has(_cell(p, q)) | has(_cell(p, p)) & has(_cell(q, q))


def _candidates(found: DataFrame | _Counted) -> DataFrame:
    """p, q: ids of close features (fid, d0..d3) of two images, the first id smaller, that meet in a table; of counted
    features only those whose images may have enough of them.

    Where up to PAIRED meet, all are paired. Of more, each meets the first and its neighbours in the order of ids, and
    comes once with itself (p = q), so that _rest() can do what is left.
    """
    import pyarrow as pa

    found, plenty = found if isinstance(found, _Counted) else (found, None)

    def run(batches):
        last = hub = np.zeros((6, 0), np.int64)
        for batch in batches:
            own = _columns(batch)
            x = np.concatenate([last, own], axis=1)
            first = x.shape[1] - own.shape[1]
            crowded = x[3] > PAIRED
            back = np.where(crowded, np.minimum(x[4] - 1, NEIGHBOURS), x[4] - 1)  # so many rows before it are met
            pairs = []
            j = np.arange(first, x.shape[1])  # pairs that end among the new rows
            for step in range(1, PAIRED):
                j = j[back[j] >= step]
                if not len(j):
                    break
                near = j[_near(x[:3, j - step], x[:3, j])]
                near = near[_may_link(plenty, x[0, near - step], x[0, near])]
                pairs.append(np.stack([x[0, near - step], x[0, near]]))
            j = first + np.flatnonzero(crowded[first:])
            if len(j):
                heads = first + np.flatnonzero(crowded[first:] & (x[4, first:] == 1))
                hubs = np.concatenate([hub, x[:, heads]], axis=1)
                theirs = hubs[:3, np.searchsorted(heads, j, "right") + hub.shape[1] - 1]
                near = _near(theirs, x[:3, j]) & _may_link(plenty, theirs[0], x[0, j])
                pairs += [np.stack([theirs[0, near], x[0, j[near]]]), np.stack([x[0, j], x[0, j]])]
                hub = hubs[:, -1:]
            last = x[:, -PAIRED:]
            if pairs:
                p, q = np.unique(np.concatenate(pairs, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["p", "q"])

    return _met(found).mapInArrow(releasing(run), "p long, q long").distinct()


def _rest(found: DataFrame, crowd: DataFrame, roots: DataFrame, plenty: Broadcast | None = None) -> DataFrame:
    """p, q: all close features of two images that meet where more than PAIRED do (crowd: fid of those that are there),
    but for images of one class (roots: node, root) that itself has more than PAIRED features at the place.

    A place is dealt in parts of BLOCK features, and each two parts meet in a task's group of their own.
    """
    import pyarrow as pa

    rows = _entries(found.join(crowd, "fid", "left_semi")).withColumn("node", _image("fid")).join(roots, "node", "left").select("place", "fid", "left", "right", F.coalesce("root", "node").alias("root"))
    rows = stored(rows)
    sizes = rows.groupBy("place", "root").agg(F.count(F.lit(1)).alias("own"))
    places = sizes.groupBy("place").agg(F.sum("own").alias("n"), F.count(F.lit(1)).alias("classes"), F.min("own").alias("least")).where((F.col("n") > PAIRED) & ((F.col("classes") > 1) | (F.col("least") <= PAIRED)))
    large = sizes.where(F.col("own") > PAIRED).select("place", "root", F.lit(True).alias("large"))
    rows = rows.join(places.select("place", F.ceil(F.col("n") / BLOCK).alias("parts")), "place").join(large, ["place", "root"], "left")
    part = F.pmod(F.xxhash64("fid"), F.col("parts"))
    dealt = rows.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("place", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"), "part", "fid", "left", "right", "root", F.coalesce("large", F.lit(False)).alias("large"))

    def run(table: pa.Table) -> pa.Table:
        x = np.stack([table.column(c).to_numpy() for c in ("fid", "left", "right", "root")])
        large, part = table.column("large").to_numpy(), table.column("part").to_numpy()
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        first, pairs = np.flatnonzero(part == one), [np.zeros((2, 0), np.int64)]
        for at, i in enumerate(first):
            j = first[at + 1 :] if one == two else np.flatnonzero(part == two)
            j = j[_near(x[:3, i : i + 1], x[:3, j]) & ~((x[3, j] == x[3, i]) & large[i])]
            j = j[_may_link(plenty, x[0, i : i + 1], x[0, j])]
            pairs.append(np.sort(np.stack([np.full(len(j), x[0, i]), x[0, j]]), axis=0))
        p, q = np.concatenate(pairs, axis=1)
        return pa.table({"p": pa.array(p, pa.int64()), "q": pa.array(q, pa.int64())})

    return dealt.groupBy("place", "one", "two").applyInArrow(run, "p long, q long").distinct()


def _matches(found: DataFrame, close: DataFrame) -> DataFrame:
    """p, q: features of two images, the first id smaller, of the close pairs (p, q, new) of images that have enough of
    them, a new one among them."""
    # Two images with too few matches can't be linked: their places and turns needn't be looked up.
    pairs = close.groupBy(_image("p").alias("a"), _image("q").alias("b")).agg(F.collect_set(F.struct("p", "q")).alias("m"), F.bool_or("new").alias("new")).where((F.size("m") >= MIN_VOTES) & F.col("new"))
    close = stored(pairs.select(F.explode("m").alias("m")).select("m.*"))
    images = close.select(F.explode(F.array(_image("p"), _image("q"))).alias("doc_id")).distinct()
    near = maybe_in(found.withColumn("doc_id", _image("fid")), images).drop("doc_id")
    row = F.struct("fid", "x", "y", "scale", "turn")
    out = close.join(near.select(F.col("fid").alias("p"), row.alias("a")), "p").join(near.select(F.col("fid").alias("q"), row.alias("b")), "q")
    return out.select(F.col("a").alias("p"), F.col("b").alias("q"))


def links(found: DataFrame) -> DataFrame:
    """a, b (a < b): images with enough corners that agree on one turn, scale and shift.

    Of crowded places, what no class joins yet is compared once the other links are known.
    """
    plenty = found.sparkSession.sparkContext.broadcast(_plenty(found))
    met = stored(_candidates(_Counted(found, plenty)))
    close = met.where("p < q").withColumn("new", F.lit(True))
    first = stored(_agreed(_matches(found, close)))
    crowd = met.where("p = q").select(F.col("p").alias("fid"))
    if crowd.isEmpty():
        return first
    more = stored(_rest(found, crowd, components(first), plenty).join(close.drop("new"), ["p", "q"], "left_anti")).withColumn("new", F.lit(True))
    if more.isEmpty():
        return first
    images = more.select(F.explode(F.array(_image("p"), _image("q"))).alias("image")).distinct()
    own = found.withColumn("image", _image("fid")).join(images, "image", "left_semi").drop("image")
    return first.unionByName(_agreed(_matches(own, more.unionByName(close.withColumn("new", F.lit(False)))))).distinct()


def _agreed(matches: DataFrame) -> DataFrame:
    """a, b (a < b): the images of matches (p, q) with enough corners that agree on one turn, scale and shift."""
    m = matches.select(
        _image("p.fid").alias("a"), _image("q.fid").alias("b"), "p", "q",
        F.expr("pmod(q.turn - p.turn, 2 * pi())").alias("turn"), F.expr("round(log2(q.scale / p.scale))").alias("zoom"),
    )
    size = F.pow(F.lit(2.0), "zoom")
    for half in (0, 1):
        m = m.withColumn(f"turn{half}", F.pmod(F.floor(F.col("turn") * TURNS / (2 * np.pi) + 0.5 * half), F.lit(TURNS)))
    votes = m.withColumn("grid", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y")) for t in (0, 1) for x in (0, 1) for y in (0, 1)))))
    cell = F.when(F.col("grid.t") == 0, F.col("turn0")).otherwise(F.col("turn1"))
    angle = (cell + 0.5 - 0.5 * F.col("grid.t")) * (2 * np.pi / TURNS)
    # All matches of a cell are turned by the cell's own angle, so that a small error moves near corners alike.
    shift_x = F.col("q.x") - size * (F.cos(angle) * F.col("p.x") - F.sin(angle) * F.col("p.y"))
    shift_y = F.col("q.y") - size * (F.sin(angle) * F.col("p.x") + F.cos(angle) * F.col("p.y"))
    span = CELL * F.greatest(size, F.lit(1.0)) * 2
    votes = votes.select("a", "b", "grid", cell.alias("cell"), "zoom", F.floor(shift_x / span + 0.5 * F.col("grid.x")).alias("sx"), F.floor(shift_y / span + 0.5 * F.col("grid.y")).alias("sy"), F.col("p.fid").alias("from"), F.col("q.fid").alias("to"))
    agreed = votes.groupBy("a", "b", "grid", "cell", "zoom", "sx", "sy").agg(F.size(F.collect_set("from")).alias("n"), F.size(F.collect_set("to")).alias("k"))
    return agreed.where((F.col("n") >= MIN_VOTES) & (F.col("k") >= MIN_VOTES)).select("a", "b").distinct()


def feature_table(rows: DataFrame) -> DataFrame:
    """fid (media_id and number of the feature) and the feature's columns of described rows."""
    found = rows.select("media_id", F.posexplode("features").alias("k", "f"))
    return found.select((F.col("media_id") * (1 << FID_BITS) + F.col("k")).alias("fid"), "f.*")


def copies(media: DataFrame) -> DataFrame:
    """media_id, class_id and n_links for each row of media (media_id, data).

    class_id is the smallest media_id that links reach, n_links the number of different images linked to this one
    directly, all of them, in classes of any size. Equal images are in one class; null, broken or featureless images are
    classes of their own, unless their bytes are equal (null ones are never equal). Repeated rows stay; other columns are
    not read. Ids are not null and below 2 ** 42 in size.
    """
    from .image_links import linked

    with small_batches(media.sparkSession):
        rows = stored(described(media.select("media_id", "data")))
        nodes = stored(rows.where("image is not null").groupBy("image").agg(F.min("media_id").alias("node")))
        # One row of each image: those that are surely no copies stay where they are, only the others are joined.
        ids = rows.where("image is not null").select(F.col("media_id").alias("doc_id"), "image")
        gone = stored(ids.join(nodes, "image").where("doc_id != node").select("doc_id").distinct())
        touched = stored(gone.unionByName(ids.groupBy("doc_id").count().where("count > 1").select("doc_id")).distinct())
        bits = bitmap(touched)
        named = rows.where("size(features) > 0").select(F.col("media_id").alias("doc_id"), "features")
        few = maybe_in(named, touched, bits).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
        first = maybe_in(named, touched, bits, False).unionByName(few).withColumnRenamed("doc_id", "media_id")
        features = rows.agg(F.coalesce(F.sum(F.size("features")), F.lit(0))).first()[0]
        found = linked(first, features)
        roots = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
        degree = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    classes = nodes.join(roots, "node", "left").join(degree, "node", "left").select("image", F.coalesce("root", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.select("media_id", "image").join(classes, "image", "left").select("media_id", F.coalesce("class_id", "media_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


# ---- a media column made from vectors -------------------------------------------------------------------------------


#: Pictures of a batch, about 1 MB.
DRAWN = 100


def draw(vector: list[float], size: int = 96) -> np.ndarray:
    """A picture that a vector of 64 numbers stands for: waves and rectangles that it places, near vectors alike."""
    e = np.resize(np.asarray(vector, np.float64), 64)
    at = np.arange(size)
    # Waves sin(x + y), as sin(x) cos(y) + cos(x) sin(y).
    x = 2 * np.pi * (0.03 + 0.25 * np.abs(e[:8])) * np.where(e[:8] < 0, -1, 1) * at[:, None]
    y = 2 * np.pi * (0.03 + 0.25 * np.abs(e[8:16])) * at[:, None] + 20 * e[16:24]
    out = 128.0 + 14 * (np.hstack([np.cos(y), np.sin(y)]) @ np.hstack([np.sin(x), np.cos(x)]).T)
    for k in range(22):
        a, b, c, d, f = (e[(5 * k + j * 7 + k // 13) % 64] for j in range(5))
        left, top = int((48 + 230 * a) % size), int((48 + 230 * b) % size)
        out[top : top + 5 + int(90 * abs(c)), left : left + 5 + int(90 * abs(d))] += 300 * f
    return np.clip(out, 0, 255)


def edit(pixels: np.ndarray, kind: int) -> np.ndarray:
    """A crop, a change of light, a quarter turn or a mirrored light change with a crop."""
    if kind == 0:
        return pixels[9:, 14:]
    if kind == 1:
        return pixels * 0.8 + 22
    if kind == 2:
        return np.rot90(pixels)
    return pixels[:-11, 5:-6] * 0.9 + 5


def media_of(vectors: DataFrame) -> DataFrame:
    """media_id, data: a graymap for each vector (vec_id, embedding), and an edited copy for each fifth."""

    import pyarrow as pa

    def drawn(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, data = [], []
        for i, vector in zip(rows.column("vec_id").to_pylist(), rows.column("embedding").to_pylist(), strict=True):
            pixels = draw(vector) if vector else None
            ids.append(2 * i)
            data.append(None if pixels is None else encode(pixels))
            if pixels is not None and i % 5 == 0:
                ids.append(2 * i + 1)
                data.append(encode(edit(np.rint(pixels), i // 5 % 4)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["media_id", "data"])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, DRAWN):
                yield drawn(batch.slice(k, DRAWN))

    return vectors.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(releasing(run), "media_id long, data binary")
