import numpy as np
import pytest

from sourcewell.llm import image_links, media


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(11)
    return [np.rint(media.draw(list(rng.normal(0, 0.125, 64)))) for _ in range(10)]


def _counts(links):
    """n_links and class_id of images with links (a, b)."""
    links = sorted(links)
    n, root = {}, {i: i for pair in links for i in pair}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {i: (n[i], root[i]) for i in n}


def test_links_of_large_classes_are_whole(spark, pictures, monkeypatch):
    """n_links counts all links of a class that is larger than a place of the tables holds; blocks give what the tables give."""
    rng = np.random.default_rng(4)
    noisy = lambda p: bytearray(media.encode(np.clip(p + rng.normal(0, 2, p.shape), 0, 255)))
    rows = [(3 * i, noisy(pictures[0])) for i in range(40)] + [(1000 + 10 * i, noisy(p)) for i, p in enumerate(pictures)]
    rows += [(1001 + 10 * i, noisy(media.edit(p, i % 4))) for i, p in enumerate(pictures)]
    df = spark.createDataFrame(rows, "media_id long, data binary")
    expected = _counts(tuple(r) for r in media.links(media.feature_table(media.described(df))).collect())
    assert len(expected) > 50 and max(n for n, _ in expected.values()) >= 39
    monkeypatch.setattr(media, "PAIRED", 16)
    for least in (image_links.LEAST_FEATURES, 400):
        monkeypatch.setattr(image_links, "LEAST_FEATURES", least)
        monkeypatch.setattr(image_links, "PIECE", 5 * least)
        got = {r.media_id: (r.n_links, r.class_id) for r in media.copies(df).collect()}
        assert got == {i: expected.get(i, (0, i)) for i, _ in rows}


def _block(rng, ids, words):
    """A block of images with six features each: words with changed bits."""
    n = 6 * len(ids)
    bits = words[rng.integers(0, len(words), n)]
    for _ in range(5):
        bits = bits ^ (rng.random((n, 4)) < 0.3) * (1 << rng.integers(0, 31, (n, 4)))
    rows = np.concatenate([np.zeros((n, 4), np.int32), bits.astype(np.int32)], axis=1)
    return image_links._Block(image_links.packed(np.array(ids), np.arange(0, n + 1, 6), rows))


@pytest.mark.parametrize("wide,at_once", [(1, 64), (1 << 13, 64), (1 << 13, 1 << 18)])
def test_close_features_are_those_of_all_pairs(monkeypatch, wide, at_once):
    monkeypatch.setattr(image_links, "WIDE", wide)
    monkeypatch.setattr(image_links, "AT_ONCE", at_once)
    rng = np.random.default_rng(7)
    words = rng.integers(-(2**31), 2**31, (4, 4))
    a, b = _block(rng, list(range(0, 80, 2)), words), _block(rng, list(range(1, 60, 2)), words)
    for x, y in ((a, b), (a, a)):
        far = np.bitwise_count(x.words[:, None] ^ y.words[None]).sum(2)
        meet = (x.bits[:, None] == y.bits[None]).any(2) & (far <= media.MAX_BITS)
        if x is y:
            meet &= x.image[:, None] < y.image[None]
        truth = set(zip(*(v.tolist() for v in np.nonzero(meet)), strict=True))
        assert len(truth) > 300
        for held in (1 << 22, 150):
            monkeypatch.setattr(image_links, "HELD", held)
            parts, got = [(range(len(x.ids)), range(len(y.ids)))], []
            if held < len(truth):
                assert image_links._close(x, y, *parts[0]) is None
            monkeypatch.setattr(image_links, "_agreeing", lambda p, q, *_: got.extend(zip(p.tolist(), q.tolist(), strict=True)) or np.zeros(0, np.int64))
            monkeypatch.setattr(image_links, "MIN_VOTES", 1)
            list(image_links._linked(x, y))
            assert len(got) == len(truth) and set(got) == truth


def test_steps_store_rows_in_proportion_to_images(spark, pictures, monkeypatch):
    """Neither matches of features, of which a class has many for each link, nor its links are stored."""
    rng = np.random.default_rng(6)
    rows = [(i, bytearray(media.encode(np.clip(pictures[1] + rng.integers(0, 2, pictures[1].shape), 0, 255)))) for i in range(80)]
    counts = []

    def counted(df, *by, own=media.stored, **options):
        out = own(df, *by, **options)
        counts.append(out.count())
        return out

    monkeypatch.setattr(media, "stored", counted)
    monkeypatch.setattr(image_links, "stored", counted)
    monkeypatch.setattr(image_links, "LEAST_FEATURES", 1000)
    got = media.copies(spark.createDataFrame(rows, "media_id long, data binary")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 79)}
    assert max(counts) <= 80 * image_links.SPREAD


@pytest.mark.parametrize("shape", [(28, 28), (29, 61), (96, 96), (27, 90)])
def test_corners_by_definition(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(float)
    gy, gx = (np.zeros(shape) for _ in "yx")
    gx[:, 1:-1], gy[1:-1] = image[:, 2:] - image[:, :-2], image[2:] - image[:-2]
    response = {}
    for y in range(12, shape[0] - 12):
        for x in range(12, shape[1] - 12):
            u, v = (g[y - 2 : y + 3, x - 2 : x + 3] for g in (gx, gy))
            xx, yy, xy = (u * u).sum() / 25, (v * v).sum() / 25, (u * v).sum() / 25
            response[y, x] = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    peak = lambda y, x: response[y, x] > 50 and response[y, x] >= max(response[y + i, x + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    truth = [(y, x) for y, x in response if 13 <= y < shape[0] - 13 and 13 <= x < shape[1] - 13 and peak(y, x)]
    truth.sort(key=lambda at: -response[at])
    if min(shape) < 28:
        assert media.describe(image) == []
        return
    x, y = media._corners(image, 1000)
    assert list(zip(y.tolist(), x.tolist(), strict=True)) == truth and (len(truth) > 2 or shape == (28, 28))


def test_waves_of_pictures():
    e = np.random.default_rng(2).normal(0, 0.125, 64)
    e[::5] *= 0
    y, x = np.mgrid[0:96, 0:96]
    out = 128.0 + sum(14 * np.sin(2 * np.pi * ((0.03 + 0.25 * abs(e[k])) * x * np.sign(e[k] or 1) + (0.03 + 0.25 * abs(e[k + 8])) * y) + 20 * e[k + 16]) for k in range(8))
    for k in range(22):
        a, b, c, d, f = (e[(5 * k + j * 7 + k // 13) % 64] for j in range(5))
        left, top = int((48 + 230 * a) % 96), int((48 + 230 * b) % 96)
        out[top : top + 5 + int(90 * abs(c)), left : left + 5 + int(90 * abs(d))] += 300 * f
    assert (np.rint(np.clip(out, 0, 255)) == np.rint(media.draw(list(e)))).all()


def test_blocks_are_read_whole(spark, monkeypatch):
    """Several blocks of one task, each larger than what a task reads and than a row group of its size would be."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(image_links, "LEAST_FEATURES", 1500)
    monkeypatch.setattr(image_links, "PIECE", 1000)
    words = [[float(v) for v in rng.integers(-(2**31), 2**31, 4)] for _ in range(5)]
    corner = lambda k, w: (10.0 * k, 7.0 * k * k % 50, 1.0, 0.5, *(int(v) for v in w))
    rows = [(i, [corner(k, w) for k, w in enumerate(words if i in (3, 900) else rng.integers(-(2**31), 2**31, (5, 4)))]) for i in range(1200)]
    df = spark.createDataFrame(rows, f"media_id long, features array<{media._FEATURE}>")
    changed = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.shuffle.partitions": "1", "parquet.block.size": "65536"}
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = image_links.linked(df, 6000).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {(r.node, r.root, r.n) for r in got} == {(3, 3, 1), (900, 3, 1)} and len(got) == 2
