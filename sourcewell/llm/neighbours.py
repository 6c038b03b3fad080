"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a graph of nearest neighbours. The graph is cut in halves again and again, each time by its slowest
mode at the middle and then by exchanges that keep the halves equal, so that few neighbours are parted. A small network
learns for a vector how its neighbours lie over the partitions. Every row belongs to its most probable partition; a query
visits partitions, the most probable first, until they hold SURE of the probability that finds TARGET of the neighbours
of vectors held back from the sample. How many that are is up to the data: vectors without any structure need most
partitions, clusters need few.

Rows meet queries in blocks of a partition, BLOCK of each side at most, so a crowded partition is many blocks. Equal
vectors are one entry with its smallest ids, and equal queries are one search. Beyond its blocks' best, nothing of a
partition leaves its task; the driver sees the sample and the partitions' counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, releasing, stored
from .vector_codes import usable

#: Distinct vectors that the partitions are learned from, and those of them held back to set how far queries go.
SAMPLE, HELD = 1 << 13, 8
#: Rows that a partition has on average, and partitions at most: SAMPLE must show each of them.
ROWS, MOST = 512, 256
#: Neighbours in the graph; the share of held-back vectors' neighbours that is to be found.
LINKS, TARGET = 10, 0.95
#: Rows and queries that meet in one task at a time.
BLOCK = 1 << 12
HIDDEN, EPOCHS, STEP, BATCH, SEED = 96, 24, 0.004, 256, 13


def _nearest(points: np.ndarray, queries: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Indexes of the k points nearest to each query; own: queries are the points, and none is its own neighbour."""
    norms, out = (points**2).sum(1), []
    for i in range(0, len(queries), 512):
        d = norms - 2 * queries[i : i + 512] @ points.T
        if own:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def _halves(nodes: np.ndarray, u: np.ndarray, v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for one half of the nodes of a graph with links u-v (each in both directions, numbered within nodes)."""
    n = len(nodes)
    degree = np.maximum(np.bincount(u, minlength=n), 1)
    mode = rng.normal(size=n)
    for _ in range(40):  # the slowest mode of a walk that stays half of the time
        mode = (mode + np.bincount(u, mode[v], minlength=n) / degree) / 2
        mode -= mode.mean()
        mode /= np.abs(mode).max() + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(mode, kind="stable")[n // 2 :]] = True
    for _ in range(12):
        gain = np.bincount(u, np.where(side[u] == side[v], -1.0, 1.0), minlength=n)
        a, b = (np.flatnonzero(side == s) for s in (False, True))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swaps = np.flatnonzero(gain[a[:m]] + gain[b[:m]] > 0)
        swaps = swaps[: max(1, len(swaps) // 2)]  # half of them, as exchanges change each other's gains
        if not len(swaps):
            break
        before = (side[u] != side[v]).sum()
        side[a[swaps]], side[b[swaps]] = True, False
        if (side[u] != side[v]).sum() >= before:
            side[a[swaps]], side[b[swaps]] = False, True
            break
    return side


def balanced_partition(links: np.ndarray, parts: int) -> np.ndarray:
    """A partition number for each node of a neighbour graph (links[i]: the neighbours of i); sizes differ by log2(parts) at most."""
    n = len(links)
    u, v = np.repeat(np.arange(n), links.shape[1]), links.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    part, rng = np.zeros(n, np.int64), np.random.default_rng(SEED)
    for _ in range(int(np.log2(parts))):
        new = part * 2
        inside = part[u] == part[v]
        for p in range(part.max() + 1):
            nodes = np.flatnonzero(part == p)
            number = np.full(n, -1)
            number[nodes] = np.arange(len(nodes))
            own = inside & (part[u] == p)
            new[nodes] += _halves(nodes, number[u[own]], number[v[own]], rng)
        part = new
    return part


class Router:
    """How probable each partition is for a vector's neighbours: one hidden layer, learned by gradient steps."""

    def __init__(self, points: np.ndarray, targets: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.middle, self.scale = points.mean(0), points.std() + 1e-12
        shape = (points.shape[1], HIDDEN), (1, HIDDEN), (HIDDEN, targets.shape[1]), (1, targets.shape[1])
        self.weights = [rng.normal(size=s) / np.sqrt(s[0]) if s[0] > 1 else np.zeros(s) for s in shape]
        x = (points - self.middle) / self.scale
        first, second = ([np.zeros(s) for s in shape] for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                rows = order[i : i + BATCH]
                step += 1
                hidden, probable = self._forward(x[rows])
                out = (probable - targets[rows]) / len(rows)
                back = (out @ self.weights[2].T) * (hidden > 0)
                slopes = x[rows].T @ back, back.sum(0, keepdims=True), hidden.T @ out, out.sum(0, keepdims=True)
                for w, g, m, s in zip(self.weights, slopes, first, second, strict=True):
                    g = g + 1e-4 * w
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= STEP * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.sure = 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ self.weights[0] + self.weights[1], 0)
        out = hidden @ self.weights[2] + self.weights[3]
        out = np.exp(out - out.max(1, keepdims=True))
        return hidden, out / out.sum(1, keepdims=True)

    def probable(self, vectors: np.ndarray) -> np.ndarray:
        return self._forward((vectors - self.middle) / self.scale)[1]

    def home(self, vectors: np.ndarray) -> np.ndarray:
        return self.probable(vectors).argmax(1)

    def mass(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector and partition: the probability of the partitions before it."""
        probable = self.probable(vectors)
        order = np.argsort(-probable, axis=1, kind="stable")
        ranked = np.take_along_axis(probable, order, 1)
        out = np.empty_like(probable)
        np.put_along_axis(out, order, ranked.cumsum(1) - ranked, 1)
        return out

    def visited(self, vectors: np.ndarray) -> np.ndarray:
        """True for the partitions that a query visits: the first one at least."""
        return self.mass(vectors) < self.sure


def learn(sample: np.ndarray, parts: int) -> Router:
    """A router for parts (a power of two) partitions, from a sample in no particular order."""
    held = sample[::HELD] if parts > 1 and len(sample) > 2 * HELD else sample[:0]
    kept = np.delete(sample, np.s_[::HELD], axis=0) if len(held) else sample
    k = min(LINKS, len(kept) - 1)
    if parts == 1 or k < 1:
        return Router(kept, np.ones((len(kept), 1)))
    links = _nearest(kept, kept, k, own=True)
    part = balanced_partition(links, parts)
    targets = np.zeros((len(kept), parts))
    np.add.at(targets, (np.arange(len(kept)), part), 1 / (k + 1))
    np.add.at(targets, (np.repeat(np.arange(len(kept)), k), part[links].ravel()), 1 / (k + 1))
    router = Router(kept, targets)
    near = _nearest(kept, held, k)
    needed = np.take_along_axis(router.mass(held), router.home(kept)[near], 1).ravel()
    router.sure = min(1.0, float(np.quantile(needed, TARGET, method="higher")) + 1e-9)
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _routed(rows: DataFrame, router: Router, visits: bool) -> DataFrame:
    """rows with part: the home of each row, or one row for each partition that a query visits."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                piece = batch.slice(start, BATCH)
                vectors = _matrix(piece.column("embedding"))
                at, part = np.nonzero(router.visited(vectors)) if visits else (np.arange(len(vectors)), router.home(vectors))
                taken = piece.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part.astype(np.int32))], [*taken.schema.names, "part"])

    from pyspark.sql.types import IntegerType, StructType

    return rows.mapInArrow(releasing(run), StructType([*rows.schema.fields]).add("part", IntegerType()))


def _counts(rows: DataFrame) -> dict[int, int]:
    """Blocks of each partition; partitions are MOST at most."""
    return {r.part: -(-r["count"] // BLOCK) for r in rows.groupBy("part").count().collect()}


def _met(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """q, d, id: the k best of each block for each query that visits its partition."""
    blocks, sheets = _counts(rows), _counts(queries)
    many = lambda counts: F.coalesce(F.create_map(*(F.lit(x) for pair in (counts or {0: 1}).items() for x in pair))[F.col("part")], F.lit(1))
    each = lambda counts: F.explode(F.sequence(F.lit(0), many(counts) - 1))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("embedding"), many(blocks)).cast("int")).withColumn("sheet", each(sheets))
    queries = queries.withColumn("sheet", F.pmod(F.xxhash64("q"), many(sheets)).cast("int")).withColumn("block", each(blocks))
    place = ["part", "block", "sheet"]

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        names, far, found = [], [], []
        if own.num_rows and asked.num_rows:
            points, vectors = (_matrix(t.column("embedding").combine_chunks()) for t in (own, asked))
            ids, q = own.column("ids").to_pylist(), asked.column("q").to_pylist()
            norms = (points**2).sum(1)
            for i in range(0, len(vectors), BATCH):
                some = vectors[i : i + BATCH]
                d = norms + (some**2).sum(1)[:, None] - 2 * some @ points.T
                limit = np.partition(d, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
                slack = 1e-9 * (norms.max() + (some**2).sum(1))  # the sum above is rounded otherwise than the distance itself
                for j, at in enumerate(d <= (limit + slack)[:, None]):
                    at = np.flatnonzero(at)
                    exact = np.sqrt(((points[at] - some[j]) ** 2).sum(1))
                    near = sorted((e, x) for e, a in zip(exact.tolist(), at.tolist(), strict=True) for x in ids[a])[:k]
                    names += [q[i + j]] * len(near)
                    far += [e for e, _ in near]
                    found += [x for _, x in near]
        return pa.table({"q": pa.array(names, pa.string()), "d": pa.array(far, pa.float64()), "id": pa.array(found, pa.int64())})

    return rows.groupBy(*place).cogroup(queries.groupBy(*place)).applyInArrow(best, "q string, d double, id bigint")


def nearest(embeddings: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of embeddings for each row of asked (both vec_id, embedding).

    Vectors that are null, empty, zero or not finite, and rows with a null id, take no part; if lengths differ, ValueError.
    No row of a query's own id is its neighbour. Ids name one vector each; rows that repeat id and vector count once. Equal
    distances are ordered by id. Fewer rows than k give all of them, found ones; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    fine = usable() & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = embeddings.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").distinct()
    first = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    base = stored(least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    text = F.concat_ws(",", F.col("embedding").cast("array<string>"))
    queries = stored(asked.where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.md5(text).alias("q")).distinct())
    n, short, long = base.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if short != long or queries.where(F.size("embedding") != F.lit(short)).limit(1).count():
        raise ValueError(f"vectors must have one length: found {short} to {long}")
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = _matrix(base.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).toArrow().column("embedding").combine_chunks())
    router = learn(sample, 2 ** int(np.clip(np.ceil(np.log2(n / ROWS)), 0, np.log2(MOST))))
    index = stored(_routed(base, router, False))
    visits = stored(_routed(queries.groupBy("q").agg(F.first("embedding").alias("embedding")), router, True))
    best = Window.partitionBy("q").orderBy("d", "id")
    found = _met(index, visits, k + 1).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("found"))
    each = dealt_join(queries.select("q", "vec_id"), lists, "q", "vec_id")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("vec_id")), 1, k)
    return each.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
