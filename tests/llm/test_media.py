import numpy as np
import pytest

from sourcewell.llm import media


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(5)
    return [np.rint(media.draw(list(rng.normal(0, 0.125, 64)))) for _ in range(24)]


def test_copies_crops_and_edits_meet(spark, pictures):
    rows, truth = [], {}
    for i, p in enumerate(pictures):
        rows.append((10 * i, bytearray(media.encode(p))))
        truth[10 * i] = 10 * i
        if i < 12:
            rows.append((10 * i + 1, bytearray(media.encode(media.edit(p, i % 4)))))
            truth[10 * i + 1] = 10 * i
    rows += [(7, rows[0][1]), (900, None), (901, None), (902, bytearray(b"not an image")), (903, bytearray(b"P5 3 3 255\n123456789")), (904, bytearray(b"P5 9 9 255\n1"))]
    rows.append(rows[3])
    truth |= {7: 0} | {i: i for i in range(900, 905)}
    got = media.copies(spark.createDataFrame([(*r, "") for r in rows], "media_id long, data binary, image string")).collect()
    assert len(got) == len(rows)
    assert {r.media_id: r.class_id for r in got} == truth
    links = {r.media_id: r.n_links for r in got}
    assert links[0] == links[7] == 1 and links[900] == 0 and links[230] == 0


def test_many_near_copies_stay_linear(spark, pictures):
    rng = np.random.default_rng(3)
    rows = [(i, bytearray(media.encode(np.clip(pictures[0] + rng.integers(0, 2, pictures[0].shape), 0, 255)))) for i in range(120)]
    df = spark.createDataFrame(rows, "media_id long, data binary")
    found = media.feature_table(media.described(df)).cache()
    assert media._candidates(found).count() < 4 * (media.PAIRED + 4 * media.NEIGHBOURS) * found.count()
    assert {r.class_id for r in media.copies(df).collect()} == {0}


def test_close_descriptors_meet_among_strangers(spark):
    """Two descriptors six bits apart, in one place with strangers that share a segment with them."""
    rng = np.random.default_rng(1)
    one = rng.integers(-(2**31), 2**31, 4)
    two = [one[0], *(int(d) ^ 0b11 for d in one[1:])]
    rows = [(i, [int(one[0]), *map(int, rng.integers(-(2**31), 2**31, 3))]) for i in range(300)]
    rows += [(120.5, two), (400, [int(d) for d in one])]
    df = spark.createDataFrame([(int(2 * i) << media.FID_BITS, *map(int, d)) for i, d in rows], "fid long, d0 int, d1 int, d2 int, d3 int")
    some = df.where(f"fid >= {2 * 295 << media.FID_BITS} or fid = {241 << media.FID_BITS}")
    for found in (some, some.union(df.where(f"fid < {40 << media.FID_BITS}"))):
        got = {(r.p >> media.FID_BITS, r.q >> media.FID_BITS) for r in media._candidates(found).collect()}
        assert got == {(241, 800)}


def test_links_against_brute_force(spark, pictures):
    """All pairs of descriptors compared: every link of the images with an id divisible by 20 is found."""
    rng = np.random.default_rng(9)
    rows = [(10 * i, media.encode(p)) for i, p in enumerate(pictures)]
    rows += [(10 * i + 1, media.encode(np.clip(media.edit(p, i % 4) + rng.normal(0, 2, media.edit(p, i % 4).shape), 0, 255))) for i, p in enumerate(pictures)]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "media_id long, data binary")
    found = media.feature_table(media.described(df)).cache()
    every = found.select("fid", "d0", "d1", "d2", "d3").collect()
    close = [
        (min(a.fid, b.fid), max(a.fid, b.fid))
        for a in every if (a.fid >> media.FID_BITS) % 20 == 0
        for b in every if a.fid >> media.FID_BITS != b.fid >> media.FID_BITS
        if sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in zip(a[1:], b[1:])) <= media.MAX_BITS  # noqa: B905
    ]
    brute = spark.createDataFrame(sorted(set(close)), "p long, q long")
    expected = {tuple(r) for r in _links_of(media, found, brute).collect()}
    got = {tuple(r) for r in media.links(found).collect()}
    assert len(expected) >= 10
    assert len(expected & got) >= 0.9 * len(expected)
    assert {x for x in got if x[0] % 20 == 0 or x[1] % 20 == 0} <= expected


def _links_of(media, found, close):
    own = media._candidates
    media._candidates = lambda _: close
    try:
        return media.links(found)
    finally:
        media._candidates = own


def test_graymaps():
    p = np.arange(12.0).reshape(3, 4)
    assert (media.decode(media.encode(p)) == p).all()
    assert media.decode(None) is None and media.decode(b"P6 1 1 255\n...") is None and media.decode(b"P5 0 0 255\n") is None


def test_empty_table(spark):
    assert media.copies(spark.createDataFrame([], "media_id long, data binary")).count() == 0


def test_crowded_places_lose_no_match(spark, monkeypatch):
    """Matches in a place of many strangers: all that brute force has, whatever the number of partitions."""
    monkeypatch.setattr(media, "PAIRED", 64)
    monkeypatch.setattr(media, "BLOCK", 100)
    rng = np.random.default_rng(2)
    draw = lambda n: rng.integers(-(2**31), 2**31, n).tolist()
    rows = [(i << media.FID_BITS, 7, *draw(3)) for i in range(700)]
    for i in range(40):
        flip = rng.choice(96, int(rng.integers(9, 14)), replace=False)
        other = [int(x) & 0xFFFFFFFF for x in rows[i * 7][2:]]
        for f in flip.tolist():
            other[f // 32] ^= 1 << f % 32
        rows.append(((700 + i) << media.FID_BITS, 7, *(x - (x >> 31 << 32) for x in other)))
    far = lambda a, b: sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in zip(a[1:], b[1:], strict=True))
    truth = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and far(a, b) <= media.MAX_BITS}
    assert 15 <= len(truth) < 40
    df = spark.createDataFrame(rows, "fid long, d0 int, d1 int, d2 int, d3 int")
    for n in (1, 7):
        found = df.repartition(n)
        met = media._candidates(found).cache()
        crowd = met.where("p = q").selectExpr("p as fid")
        assert crowd.count() == len(rows)
        none = spark.createDataFrame([], "node long, root long")
        assert {tuple(r) for r in media._rest(found, crowd, none).collect()} == truth
        one = df.selectExpr(f"shiftright(fid, {media.FID_BITS}) as node", "0L as root").where("node < 10 or node >= 700")
        assert {tuple(r) for r in media._rest(found, crowd, one).collect()} == truth
        large = df.selectExpr(f"shiftright(fid, {media.FID_BITS}) as node", "1L as root").where("node != 0")
        assert {tuple(r) for r in media._rest(found, crowd, large).collect()} == {x for x in truth if 0 in x}


def test_links_in_crowds_are_those_of_all_pairs(spark, pictures, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, bytearray(media.encode(np.clip(pictures[i % 6] + rng.normal(0, 3, pictures[0].shape), 0, 255)))) for i in range(60)]
    found = media.feature_table(media.described(spark.createDataFrame(rows, "media_id long, data binary"))).cache()
    every = {tuple(r) for r in media.links(found).collect()}
    monkeypatch.setattr(media, "PAIRED", 16)
    crowded = {tuple(r) for r in media.links(found).collect()}
    assert len(every) > 200 and crowded == every


def test_chance_matches_make_no_pairs(spark, monkeypatch):
    """One corner that all images share: only images with enough matches become pairs, in crowds too, and none of them is lost."""
    rng = np.random.default_rng(6)
    word = lambda: [int(d) for d in rng.integers(-(2**31), 2**31, 4)]
    common, shared = word(), [word() for _ in range(media.MIN_VOTES - 1)]
    rows = [(i << media.FID_BITS, *common) for i in range(400)]
    rows += [((i << media.FID_BITS) + 1 + k, *(shared[k] if i in (0, 123, 399) else word())) for i in range(400) for k in range(len(shared))]
    found = spark.createDataFrame(rows, "fid long, d0 int, d1 int, d2 int, d3 int")
    truth = {(a, b, k) for a, b in ((0, 123), (0, 399), (123, 399)) for k in range(media.MIN_VOTES)}
    named = lambda df: {(r.p >> media.FID_BITS, r.q >> media.FID_BITS, r.p & 7) for r in df.where("p < q").collect()}
    every = named(media._candidates(found))
    assert len(every) > 70_000
    for counted, paired in ((media.COUNTED, media.PAIRED), (media.COUNTED, 64), (300, media.PAIRED)):
        monkeypatch.setattr(media, "COUNTED", counted)
        monkeypatch.setattr(media, "PAIRED", paired)
        plenty = spark.sparkContext.broadcast(media._plenty(found))
        met = media._candidates(media._Counted(found, plenty)).cache()
        got = named(met)
        if paired == 64:
            none = spark.createDataFrame([], "node long, root long")
            got |= named(media._rest(found, met.where("p = q").selectExpr("p as fid"), none, plenty))
        assert got == (truth if counted > 300 else every)  # images with a corner that isn't counted are never ruled out
