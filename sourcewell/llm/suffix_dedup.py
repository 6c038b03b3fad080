"""Removal of long repeated passages with suffix arrays.

A window is any run of WIDTH bytes. Its anchor is the place of its least hashed GRAM-byte string; windows next to
each other mostly share it and form a run. Equal windows have equal anchors, so shards made by anchor see all
windows that can be equal, and whatever is cut off from its copies by nothing but distance needs no pairwise look.
Runs whose anchor is nowhere else are done. Runs that are equal as a whole are repeated as a whole. The rest, each
distinct run once, goes to shards by anchor: a suffix array with common prefixes finds the repeated windows of a
shard. An anchor with very many distinct runs is spread over several shards, whose windows are then merged by binary
search.

Whole runs, and windows in that merge, are compared by hashes of 64 bits within one anchor, itself a hash of 64 bits:
among m runs of one anchor a wrong match has a chance of m * m / 2 ** 65, less than 1 in 30 for 10 ** 9 of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DEALS, deal_mask, deals, dealt, map_texts, stored
from .suffix_array import repeated_windows

WIDTH = 200
GRAM = 32
#: Bytes of one shard; a shard also takes the rest of its last anchor's runs.
SHARD_BYTES = 2 << 20
#: Distinct runs of one anchor in a shard (a run has at most 2 * WIDTH bytes).
ANCHOR_RUNS = 8_000
#: Bytes hashed at once; longer texts are read in overlapping segments.
SEGMENT = 4 << 20
#: Bits of the bitmap of documents whose text has to travel; its size, 2 MB, doesn't depend on the data.
BITMAP_BITS = 24

_TABLE = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_BITS = 23
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    h = _TABLE[data]
    width = 1
    for m in _MULTIPLIERS[:5]:
        h = h[:-width] * m + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _MULTIPLIERS[5]
    return h ^ (h >> np.uint64(29))


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run, in texts that end at `ends` in data."""
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none, none, np.zeros(0, np.uint64)
    grams = _grams(data)
    least = (grams >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    n, have = WIDTH - GRAM + 1, 1
    while have < n:  # least of the next `have` places
        step = min(have, n - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    valid = np.ones(len(place), bool)
    for end in ends[:-1].tolist():
        valid[max(0, end - WIDTH + 1) : end] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    place = place[at]
    heads = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    return at[heads], np.diff(np.append(heads, len(at))), grams[place[heads]]


_RUNS = "doc_id long, th long, anchor long, content long, weight int, start long, windows int"


def _run_rows(rows: dict[str, list]) -> dict[str, list]:
    """Distinct runs of each text. A run that the text repeats has weight 2; its places are all given, the further
    ones without an anchor, as they are known to be repeated."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out: dict[str, list] = {k: [] for k in ("doc_id", "th", "anchor", "content", "weight", "start", "windows")}
    signed = lambda x: x - (x >> 63 << 64)

    def work(owners: list[tuple[int, int, int]], parts: list[bytes]) -> None:
        """owners: id, text hash and offset in the text of each part."""
        raw = b"".join(parts)
        bounds = np.cumsum([len(p) for p in parts])
        first, windows, anchors = runs(np.frombuffer(raw, np.uint8), bounds)
        part = np.searchsorted(bounds, first, side="right").tolist()
        offsets = [0, *bounds.tolist()]
        seen: dict[tuple[int, int, int], list[int]] = {}
        for k, (a, w, anchor) in enumerate(zip(first.tolist(), windows.tolist(), anchors.tolist(), strict=True)):
            seen.setdefault((part[k], anchor, digest(raw[a : a + w + WIDTH - 1])), []).append(k)
        first, windows = first.tolist(), windows.tolist()
        for (p, anchor, content), places in seen.items():
            doc, th, base = owners[p]
            for n, k in enumerate(places):
                row = (doc, th, None if n else signed(anchor), signed(content), min(2, len(places)), first[k] - offsets[p] + base, windows[k])
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)

    owners: list[tuple[int, int, int]] = []
    parts: list[bytes] = []
    size = 0
    for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
        raw = (text or "").encode()
        if len(raw) < WIDTH:
            continue
        th = signed(digest(raw))
        for base in range(0, len(raw) - WIDTH + 1, SEGMENT):
            if size and size + min(len(raw), SEGMENT) > SEGMENT:
                work(owners, parts)
                owners, parts, size = [], [], 0
            owners.append((doc, th, base))
            parts.append(raw[base : base + SEGMENT + WIDTH - 1])
            size += len(parts[-1])
    if parts:
        work(owners, parts)
    return out


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of fixed size of the documents in keys (doc_id, th)."""
    words = keys.select(F.shiftrightunsigned("th", 64 - BITMAP_BITS + 5).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(th, {64 - BITMAP_BITS}) & 31 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    for r in words.collect():  # at most 2 ** (BITMAP_BITS - 5) rows
        out[r.word] = r.bits
    return out


def _travelling(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, th, text, n_bytes and whole (sha256 of the text) of all documents; text is null where the bitmap of
    keys says that the document isn't among them, so that it doesn't travel in a join."""
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def run(rows: dict[str, list]) -> dict[str, list]:
        bits = shared.value
        out: dict[str, list] = {"doc_id": rows["doc_id"], "th": [], "text": [], "n_bytes": [], "whole": []}
        for text in rows["text"]:
            raw = (text or "").encode()
            th = xxhash.xxh3_64_intdigest(raw)
            place = th >> (64 - BITMAP_BITS)
            out["th"].append(th - (th >> 63 << 64))
            out["text"].append(raw if int(bits[place >> 5]) >> (place & 31) & 1 else None)
            out["n_bytes"].append(len(raw))
            out["whole"].append(hashlib.sha256(raw).hexdigest())
        return out

    return map_texts(docs, run, "doc_id long, th long, text binary, n_bytes long, whole string")


_SPANS = "doc_id long, th long, a long, b long"


def _shard_spans(rows: list[tuple], merge: list) -> list[tuple]:
    """(doc_id, th, a, b) for the repeated windows of distinct runs; of a spread anchor each distinct window also goes to
    merge, once: its own place if the shard doesn't repeat it, else any.

    rows: doc_id, th, anchor, salt, spread (shards of the anchor), weight, start, content.
    """
    import xxhash

    raw = b"".join(r[7] for r in rows)
    lengths = np.array([len(r[7]) for r in rows])
    ends = np.cumsum(lengths)
    offsets = ends - lengths
    starts = np.ones(len(raw), bool)
    for k in range(WIDTH - 1):
        starts[ends - 1 - k] = False
    found = repeated_windows(np.frombuffer(raw, np.uint8), starts, WIDTH)
    met: set[tuple[int, int]] = set()
    for r, offset, length in zip(rows, offsets.tolist(), lengths.tolist(), strict=True):
        if r[4] > 1:
            for i in range(offset, offset + length - WIDTH + 1):
                key = xxhash.xxh3_64_intdigest(raw[i : i + WIDTH]) - (1 << 63)
                if not found[i] or (r[2], key) not in met:
                    merge.append((r[0], r[1], r[2], r[4], r[6] + i - offset, key))
                    if found[i]:
                        met.add((r[2], key))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
    firsts, lasts = edges[::2], edges[1::2] - 1
    own = np.searchsorted(ends, firsts, side="right").tolist()
    return [(r[0], r[1], r[6] + a - offsets[k], r[6] + b - offsets[k]) for k, a, b in zip(own, firsts.tolist(), lasts.tolist(), strict=True) if (r := rows[k])[5] < 2]


_SHARDED = "doc_id long, th long, a long, b long, anchor long, spread int, key long"


def _shards(batches):
    """Cut a partition, ordered by anchor and salt, into shards; spans have no key, windows to merge have one."""
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in _SHARDED.split(", "))])

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        merge: list[tuple] = []
        spans = [(*s, None, None, None) for s in _shard_spans(rows, merge)]
        spans += [(doc, th, at, at, anchor, spread, key) for doc, th, anchor, spread, at, key in merge]
        columns = list(zip(*spans, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            group = (row[2], row[3])
            if size >= SHARD_BYTES and group != last:
                yield emit(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[7])
            last = group
    if rows:
        yield emit(rows)


def _merge(pdf):
    """Windows of one bucket of a spread anchor, one row for each shard that has them: a key that binary search finds
    more than once is in several shards."""
    keys = pdf["key"].to_numpy()
    order = np.sort(keys)
    hit = np.searchsorted(order, keys, "right") - np.searchsorted(order, keys, "left") > 1
    return pdf.loc[hit, ["doc_id", "th", "a", "b"]]


def repeated_spans(docs: DataFrame, anchor_runs: int = ANCHOR_RUNS) -> DataFrame:
    """doc_id, th (hash of the text), a, b: first and last start of stretches of repeated windows, each at least once."""
    found = stored(map_texts(docs, _run_rows, _RUNS))
    inner = found.where("anchor is null").selectExpr("doc_id", "th", "start as a", "start + windows - 1 as b")
    keyed = dealt(found.where("anchor is not null"), "doc_id")
    twice = keyed.groupBy("anchor").agg(F.sum("weight").alias("n"), deal_mask()).where("n > 1")
    shared = stored(keyed.join(deals(twice, "anchor"), ["anchor", "deal"], "left_semi"))
    groups = stored(shared.groupBy("anchor", "content").agg(F.sum("weight").alias("weight"), F.min(F.struct("doc_id", "th", "start", "windows")).alias("one"), deal_mask()))
    whole = shared.join(deals(groups.where("weight > 1"), "anchor", "content"), ["anchor", "content", "deal"], "left_semi").selectExpr("doc_id", "th", "start as a", "start + windows - 1 as b")

    distinct = dealt(groups.drop("mask"), "content")
    mixed = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), deal_mask()).where("n > 1")
    shards_of = F.ceil(F.col("n") / anchor_runs).cast("int")
    rest = distinct.join(deals(mixed, "anchor", "n"), ["anchor", "deal"]).select("one.*", "anchor", F.pmod("content", shards_of).cast("int").alias("salt"), shards_of.alias("spread"), F.least("weight", F.lit(2)).cast("int").alias("weight"))
    wanted = stored(rest.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "windows", "anchor", "salt", "spread", "weight")).alias("runs")))
    texts = _travelling(docs, wanted.select("doc_id", "th")).where("text is not null").select("doc_id", "th", "text")
    texts = texts.join(wanted, (texts.doc_id.eqNullSafe(wanted.doc_id)) & (texts.th == wanted.th)).select(texts.doc_id, texts.th, "text", F.explode("runs").alias("r"))
    pieces = texts.select("doc_id", "th", "r.anchor", "r.salt", "r.spread", "r.weight", "r.start", F.expr(f"substring(text, cast(r.start + 1 as int), r.windows + {WIDTH - 1})").alias("content"))
    shards = pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_shards, _SHARDED)
    shards = stored(shards)
    spans = shards.where("key is null").select("doc_id", "th", "a", "b")
    # As many buckets as the anchor's runs ask for: a bucket keeps its size however many texts share a passage.
    bucket = F.pmod(F.shiftright("key", 16), F.lit(DEALS) * F.col("spread"))
    merged = shards.where("key is not null").groupBy("anchor", bucket.alias("bucket")).applyInPandas(_merge, _SPANS)
    return inner.unionByName(whole).unionByName(spans).unionByName(merged)


def _kept(raw: bytes, spans: list[dict]) -> tuple[int, int, str]:
    removed, n, end, kept = 0, 0, 0, hashlib.sha256()
    for s in sorted(spans, key=lambda s: s["a"]):
        a, b = s["a"], s["b"] + WIDTH
        if a > end or not n:
            kept.update(raw[end:a])
            n += 1
            removed += b - a
        else:
            removed += max(0, b - end)
        end = max(end, b)
    kept.update(raw[end:])
    return removed, n, kept.hexdigest()


def remove_repeats(docs: DataFrame, anchor_runs: int = ANCHOR_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs (doc_id, text).

    Every byte inside a 200-byte string that also starts elsewhere, in any row or the same one, is removed; places
    are judged on the input. Null texts count as empty; texts of fewer than 200 bytes keep all; repeated rows are
    documents of their own and so remove each other; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    spans = stored(repeated_spans(docs, anchor_runs).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    texts = _travelling(docs, spans.select("doc_id", "th"))
    joined = texts.join(spans.withColumnsRenamed({"doc_id": "d", "th": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "n_bytes", "whole", F.when(F.col("spans").isNotNull(), F.col("text")).alias("text"), "spans")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [_kept(r["text"], r["spans"]) if r["spans"] else (0, 0, r["whole"]) for r in rows]
            removed, n, kept = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
