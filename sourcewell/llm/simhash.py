"""SimHash near-duplicates by multi-index hashing.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of one of their halves. Each
distinct fingerprint is stored under both halves and looked up under every half at a Hamming distance of at most one;
matches are kept if the whole distance is at most three. Of two fingerprints whose halves differ in one bit, the one
with a zero there does the looking up.

A half that very many distinct fingerprints share is not compared pair by pair. Within it, all members enumerate the
other half's ball of radius one, and members also that of radius two: fingerprints that meet a member of radius one
at a point are at most three bits from it, and any two that are linked do meet so. A point holds a bounded number of
distinct fingerprints, and each emits a constant number of points, so the work stays linear.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_texts
from .components import components

SHINGLE, MAX_BITS = 3, 3
#: Halves that more distinct fingerprints share are linked by points instead of pairs.
PAIR_LIMIT = 256
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text as an unsigned number; zero without words.

    Words are what ASCII white space separates, with A-Z lower-cased; a text of fewer words is one shingle.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else [b" ".join(words)]  # noqa: B905
    numbers = np.array([digest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(numbers), _BLOCK):
        ones += np.unpackbits(numbers[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(numbers)).view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row of docs (doc_id, text)."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [fingerprint(t, shingle) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "fp": [x - (x >> 63 << 64) for x in found]}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """a, b: edges between nodes (node, fp; fp distinct) that connect exactly what links of at most three bits connect."""
    halves = F.explode(F.expr("array(struct(0 as seg, cast(fp & 4294967295 as long) as half, cast(shiftrightunsigned(fp, 32) as long) as rest), struct(1 as seg, cast(shiftrightunsigned(fp, 32) as long) as half, cast(fp & 4294967295 as long) as rest))")).alias("h")
    entries = nodes.select("node", "fp", halves).select("node", "fp", "h.*")
    flips = F.expr("filter(transform(sequence(0, 31), i -> shiftleft(1L, i)), b -> (half & b) = 0)")
    looked = entries.select("node", "fp", "seg", "rest", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("flip"), "half").withColumn("half", F.col("half").bitwiseOR(F.col("flip")))
    crowded = entries.groupBy("seg", "half").count().where(F.col("count") > pair_limit).select("seg", "half")

    stored = entries.join(crowded, ["seg", "half"], "left_anti").select("seg", "half", F.col("node").alias("other"), F.col("fp").alias("other_fp"))
    pairs = looked.join(stored, ["seg", "half"]).where((_distance("fp", "other_fp") <= MAX_BITS) & ((F.col("flip") != 0) | (F.col("fp") < F.col("other_fp"))))
    pairs = pairs.select(F.col("node").alias("a"), F.col("other").alias("b"))

    # Points of the crowded halves: radius one from members and from one-bit neighbours, radius two from members.
    # A neighbour may have its zero or its one at the flipped bit; both look in, as links go to members only.
    all_flips = F.expr("transform(sequence(0, 31), i -> shiftleft(1L, i))")
    near = entries.select("node", "seg", "rest", F.explode(F.concat(F.array(F.lit(0).cast("long")), all_flips)).alias("flip"), "half").withColumn("half", F.col("half").bitwiseXOR(F.col("flip")))
    near = near.join(crowded, ["seg", "half"], "left_semi")
    one = "transform(sequence(-1, 31), i -> struct(if(i < 0, rest, rest ^ shiftleft(1L, i)) as point, flip = 0 as member))"
    two = "flatten(transform(sequence(1, 31), i -> transform(sequence(0, i - 1), j -> struct(rest ^ shiftleft(1L, i) ^ shiftleft(1L, j) as point, false as member))))"
    points = near.select("node", "seg", "half", F.explode(F.expr(f"if(flip = 0, concat({one}, {two}), {one})")).alias("p")).select("node", "seg", "half", "p.*")
    hub = F.min(F.when(F.col("member"), F.col("node"))).over(Window.partitionBy("seg", "half", "point"))
    starred = points.withColumn("b", hub).where("b is not null and node != b").select(F.col("node").alias("a"), "b")
    return pairs.unionByName(starred)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links of at most three differing bits reach. Null, empty and wordless
    texts have fingerprint zero and link like any other. Equal fingerprints are one node, so copies cost nothing more;
    repeated rows stay; an empty table gives no rows; other columns are not read; whole texts count.
    """
    prints = cut(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(links(nodes, pair_limit))
    roots = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(roots, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
