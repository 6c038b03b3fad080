"""One document of each group of near copies: SimHash links, exact shingle similarity, prefix filter, components.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Pairs come from
the operator of SimHash prints, by its multi-index hashing, and are checked by their whole sets. Prints within three bits
don't reach all pairs at the threshold, so those that they miss come from an exact prefix filter: two such sets of any order of all shingles share one among the first n - ceil(0.8 n) + 1 of each (exact prefix filter), so texts that
share none there are surely none. The order puts shingles that few texts have first, by a table of estimated counts of
fixed size; the estimate only decides how many candidates there are, never which pairs are found.

A pair that meets is ruled out natively by the lengths of the two sets and by the places of the common shingle in both
orders, then by sketches: the numbers of shingles in each of some hash buckets, about a byte a shingle, of which the
smaller ones add up to no less than the common shingles. Whole sets are compared for what is left. All three rules are
sound, so no pair at the threshold is lost.

Where few texts meet at a shingle, all are paired. Where many meet, each is paired with the first of them; then those
that are not linked yet are paired with each other across their groups, with texts of like lengths only and except
where the triangle inequality of the Jaccard distance to that first text rules a pair out, or where too little follows
the first place that both have: nothing before it is common. So no pair at the threshold is missed that isn't linked
otherwise, and a large group of copies needs a number of pairs in proportion to its size, also if many edits of its text
are too far from all others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, dealt_join, map_texts, maybe_in, releasing, slices, stored
from .components import components
from .simhash import fingerprint
from .simhash import links as print_links

SHINGLE, SIMILARITY = 5, 0.8
#: All texts that meet at a shingle are paired up to this number of them; more are first paired with one of them.
CROWD = 8
#: Bits of the table of estimated shingle counts: its size, 16 MB, doesn't depend on the data.
COUNT_BITS = 22
_STEP = np.uint64(0x9FB21C651E98DF25)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words than a shingle is one."""
    import xxhash

    width = min(SHINGLE, len(words))
    if not width:
        return np.zeros(1, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(each) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ each[k : k + n]) * _STEP
            out ^= out >> np.uint64(29)
    return np.unique(out)


def _place(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _counts(docs: DataFrame) -> np.ndarray:
    """Estimated number of texts with a shingle, by the upper bits of its hash; places that are not frequent have 0."""

    def run(batches):
        seen, total = np.zeros(1 << COUNT_BITS, np.int32), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    places = _place(_shingles(_words(text)))
                    seen[places] += 1
                    total += len(places)
        mean = total / len(seen)  # what chance puts in a place
        at = np.flatnonzero(seen > mean + 3 * math.sqrt(mean) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at].astype(np.int64))], ["place", "n"])

    found = docs.select("text").mapInArrow(releasing(run), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.uint32)  # at most 2 ** COUNT_BITS rows, whatever the number of texts
    out[found.column("place").to_numpy()] = np.minimum(found.column("n").to_numpy(), 0xFFFFFFFF)
    return out


def _sketch(shingles: np.ndarray) -> bytes:
    """Number of shingles in each bucket of their upper bits, 255 at most; about one shingle a bucket, 64 buckets at least."""
    bits = max(6, len(shingles).bit_length() - 1)
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _most_common(x: bytes, y: bytes) -> int:
    """No fewer than the common shingles of two sketches' sets."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if p.max() == 255 or q.max() == 255:
        return 1 << 62
    p, q = (v.reshape(min(len(p), len(q)), -1).sum(1, dtype=np.int64) for v in (p, q))
    return int(np.minimum(p, q).sum())


def _enough(common, m, n, similarity: float):
    """Are so many common shingles enough for sets of m and n shingles, numbers or columns?"""
    return common * (1 + similarity) >= (m + n) * similarity - 1e-6


def _prints(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, norm (hash of the lower-cased words), n (number of shingles), segments (those of its prefix, in order),
    sketch and fp (SimHash print) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(_counts(docs))

    def run(rows: dict[str, list]) -> dict[str, list]:
        import xxhash

        out: dict[str, list] = {"doc_id": rows["doc_id"], "norm": [], "n": [], "segments": [], "sketch": [], "fp": []}
        for text in rows["text"]:
            words = _words(text)
            own = _shingles(words)
            most = len(own) - math.ceil(len(own) * similarity - 1e-9) + 1
            order = np.argsort(shared.value[_place(own)], kind="stable")  # ties by hash
            out["norm"].append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
            out["n"].append(len(own))
            out["segments"].append(own[order[:most]].view(np.int64).tolist())
            out["sketch"].append(_sketch(own))
            bits = fingerprint(text, SHINGLE)
            out["fp"].append(bits - (bits >> 63 << 64))
        return out

    return map_texts(docs, run, "doc_id long, norm string, n int, segments array<long>, sketch binary, fp long")


def _by_prints(nodes: DataFrame) -> DataFrame:
    """a, b: distinct pairs of nodes (node, fp), a > b, that SimHash links: each with the first of its print, and the first
    ones of prints that differ in few bits."""
    first = stored(nodes.groupBy("fp").agg(F.min("node").alias("low")))
    same = nodes.join(first, "fp").where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    pairs = same.unionByName(print_links(first.select(F.col("low").alias("node"), "fp")))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _meetings(nodes: DataFrame) -> DataFrame:
    """key, node, at (place in its prefix), n (number of shingles), low (least node of the key) and met (nodes of the
    key), for the shingles that the prefixes of several nodes (node, n, segments) have."""
    entries = nodes.select("node", "n", F.posexplode("segments").alias("at", "key"))
    places = stored(entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("met")).where("low != high").drop("high"))
    # Most shingles are in one prefix only: the bitmap keeps them out of the join.
    few = maybe_in(entries.withColumnRenamed("key", "doc_id"), places.select(F.col("key").alias("doc_id"))).withColumnRenamed("doc_id", "key")
    return stored(dealt_join(stored(few), places, "key", "node"))


def _few_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """a, b: distinct pairs, a > b, that meet where at most CROWD do and that lengths and places allow."""
    row = F.struct("node", "at", "n")
    few = met.where(F.col("met") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_list(row)).alias("s"))
    pairs = few.select(F.explode(F.expr("flatten(transform(s, (b, i) -> transform(slice(s, i + 2, size(s)), a -> struct(a, b))))")).alias("p")).select("p.*")
    return pairs.where(_allowed("a", "b", similarity)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _allowed(a: str, b: str, similarity: float):
    """Can two sets be near that have a shingle at these places of their orders? What stands before it in one order is
    in the other before it as well, if at all, and so is what follows it."""
    at = lambda f, less: F.least(F.col(f"{a}.{f}") - less(a), F.col(f"{b}.{f}") - less(b))
    before, after = at("at", lambda _: F.lit(0)), at("n", lambda side: F.col(f"{side}.at") + 1)
    return _enough(before + 1 + after, F.col(f"{a}.n"), F.col(f"{b}.n"), similarity)


def _star_pairs(met: DataFrame) -> DataFrame:
    """a, b: distinct pairs of a node and the least one at a crowded place."""
    return met.where((F.col("met") > CROWD) & (F.col("node") != F.col("low"))).select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()


def _candidates(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: the pairs of nodes (node, n, segments) that meet; at crowded places those with the least node only."""
    met = _meetings(nodes)
    return _few_pairs(met, similarity).unionByName(_star_pairs(met)).distinct()


def _spans(met: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """key, hi, lo, main, node, n, at, low, root, size: the nodes of crowded places that may still have a pair there, by the
    length classes of the two; main is one of the roots that meet.

    Lengths of near texts fall into one class of a factor of 1 / similarity or into two that follow each other. A pair that
    shares an earlier shingle of both orders has met there, so here none that stands before the place is common. A node
    is left out where what follows is too little for the shortest text of the other class; so is a place that has one root.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity)) if similarity < 1 else F.col("n")
    own = met.where(F.col("met") > CROWD).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("size", size.cast("long"))
    mate = F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1))
    shortest = F.pow(F.lit(1 / similarity), "mate") * (1 - 1e-9) if similarity < 1 else F.col("mate")
    own = own.withColumn("mate", mate).where(_enough(F.col("n") - F.col("at"), F.col("n"), F.greatest(shortest, F.col("n") * similarity), similarity))
    span = [F.greatest("size", "mate").alias("hi"), F.least("size", "mate").alias("lo")]
    rows = stored(own.select("key", *span, "node", "n", "at", "low", "root", "size"))
    mixed = rows.groupBy("key", "hi", "lo").agg(F.min("root").alias("main"), F.max("root").alias("last")).where("main != last").drop("last")
    return stored(rows.join(stored(mixed), ["key", "hi", "lo"]))  # stored, so that Spark can split a hot place


def _across(spans: DataFrame, judged: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs at crowded places that no component joins yet and that lengths, places and the similarities to the
    least node allow. A node that isn't near the least one has a similarity to it between 0 and the threshold. Texts that
    have many such places in common are paired at the first of them only. Nodes of the main root aren't compared with each other."""
    keys = spans.groupBy("node").agg(F.transform(F.sort_array(F.collect_set(F.struct("at", "key"))), lambda x: x["key"]).alias("keys"))
    hub = judged.select(F.col("a").alias("node"), F.col("b").alias("low"), "alike")
    same = F.when(F.col("node") == F.col("low"), 1.0).otherwise(F.col("alike"))
    bounds = [F.coalesce(same, F.lit(0.0)).alias("least"), F.coalesce(same, F.lit(similarity)).alias("most")]
    rows = spans.join(keys, "node").join(hub, ["node", "low"], "left")
    rows = stored(rows.select("key", "hi", "lo", "main", "root", "size", F.struct("node", "at", "n").alias("a"), *bounds, "keys"))
    x = rows.where("root != main")
    y = rows.select("key", "hi", "lo", F.col("root").alias("other"), F.col("size").alias("length"), F.col("a").alias("b"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("keys").alias("theirs"))
    once = (F.col("root") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("a.node") > F.col("b.node")))
    classes = (F.col("hi") == F.col("lo")) | (F.col("size") != F.col("length"))
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    apart = F.greatest(F.col("least") - F.col("high"), F.col("low") - F.col("most")) <= 1 - similarity + 1e-9
    first = F.get(F.array_intersect("keys", "theirs"), F.lit(0)) == F.col("key")
    pairs = x.join(y, ["key", "hi", "lo"]).where(once & classes & _enough(left, F.col("a.n"), F.col("b.n"), similarity) & apart & first)
    return pairs.select(F.greatest("a.node", "b.node").alias("a"), F.least("a.node", "b.node").alias("b")).distinct()


def _both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b) with x and y, the value that rows (doc_id, value) has for a and for b."""
    value = rows.columns[1]
    first = pairs.join(rows.select(F.col("doc_id").alias("a"), F.col(value).alias("x")), "a")
    # Many a's meet the same b, the first of a crowd: its value is given to several tasks.
    return dealt_join(first, rows.select(F.col("doc_id").alias("b"), F.col(value).alias("y")), "b", "a").select("a", "b", "x", "y")


def _possible(nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) without those that their sketches rule out; nodes: node, n, sketch."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = pa.array([_enough(_most_common(p["sketch"], q["sketch"]), p["n"], q["n"], similarity) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    known = maybe_in(nodes.select(F.col("node").alias("doc_id"), F.struct("n", "sketch").alias("value")), ids)
    return _both(pairs, known).mapInArrow(releasing(run), "a long, b long")


def _judged(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with alike, the Jaccard similarity of the whole texts' shingles."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = maybe_in(docs, ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def sets(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "grams": [_shingles(_words(t)).view(np.int64) for t in rows["text"]]}

    grams = stored(map_texts(texts, sets, "doc_id long, grams array<long>"))
    common = F.size(F.array_intersect("x", "y"))
    return _both(pairs, grams).select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("alike"))


def _linked(docs: DataFrame, nodes: DataFrame, similarity: float, linked: DataFrame | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Near pairs (a, b) of those that meet and of linked, near pairs across the components that these make, and those
    components; None for no such pairs, or if there was nothing to join."""
    met = _meetings(nodes)
    pairs = _few_pairs(met, similarity).unionByName(_star_pairs(met))
    pairs = stored((pairs if linked is None else pairs.unionByName(linked)).distinct())
    judged = stored(_judged(docs, stored(_possible(nodes, pairs, similarity))))
    near = judged.where(F.col("alike") >= similarity - 1e-12).select("a", "b")
    if met.where(F.col("met") > CROWD).isEmpty():
        return near, None, None
    roots = stored(components(near))
    spans = _spans(met, roots, similarity)
    if spans.isEmpty():
        return near, None, roots
    rest = stored(_across(spans, judged, similarity).join(pairs, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return near, None, roots
    more = _judged(docs, stored(_possible(nodes, rest, similarity)))
    return near, stored(more.where(F.col("alike") >= similarity - 1e-12).select("a", "b")), roots


def links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, linked: DataFrame | None = None) -> DataFrame:
    """a, b: pairs of nodes (node, n, segments, sketch) at least that similar, enough of them to join all such pairs' groups.
    linked: pairs (a, b; a > b) to check besides those that meet."""
    near, more, _ = _linked(docs, nodes, similarity, linked)
    return near if more is None else near.unionByName(more)


def _roots(docs: DataFrame, nodes: DataFrame, similarity: float, linked: DataFrame) -> DataFrame:
    """node, root: the components of links(). Those that the first pairs make aren't made again."""
    near, more, roots = _linked(docs, nodes, similarity, linked)
    if roots is None:
        return components(near)
    if more is None or more.isEmpty():
        return roots
    return components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id (smallest doc_id of its group) for each row of docs (doc_id, text) that isn't its group's first.

    Texts with equal words are copies, wordless, null and empty ones among them too. Every id stands for one text.
    """
    docs = docs.select("doc_id", "text")
    prints = stored(_prints(docs, similarity))
    # Rows of one norm are one node, that of the smallest id; only its prefix and sketch are read on.
    nodes = stored(prints.groupBy("norm").agg(F.min("doc_id").alias("node")))
    first = prints.where("doc_id is not null").join(nodes.select(F.col("norm"), F.col("node").alias("doc_id")), ["norm", "doc_id"], "left_semi").dropDuplicates(["norm"])
    first = stored(first.select(F.col("doc_id").alias("node"), "n", "segments", "sketch", "fp"))
    roots = _roots(docs, first.drop("fp"), similarity, _by_prints(first.select("node", "fp")))
    groups = nodes.join(roots, "node", "left").select("norm", F.coalesce("root", "node").alias("group_id"))
    return prints.join(groups, "norm").where("doc_id != group_id").select("doc_id", "group_id")


def drop_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that copies() names: of each group the smallest doc_id stays. Rows that repeat an id
    stay or go together, and one of rows with equal id and text stays. Rows without an id stay. Other columns stay."""
    named = docs.select("doc_id", "text")
    gone = stored(copies(named, similarity).select("doc_id").distinct())
    norm = stored(_repeated(named))
    touched = gone.unionByName(norm).distinct()
    bits = bitmap(touched)
    few = maybe_in(docs, touched, bits).join(gone, "doc_id", "left_anti").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return maybe_in(docs, touched, bits, False).unionByName(few)


def _repeated(docs: DataFrame) -> DataFrame:
    """Ids that more than one row has."""
    return docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
