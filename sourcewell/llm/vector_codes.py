"""Product codes of vectors: four codebooks of 256 entries, refined in rounds; the nearest entry is found by Orchard search.

For every entry the other entries are listed by their distance from it. A search starts at some entry, walks its list and
jumps to the list of an entry that is nearer to the point; entries once measured are marked and not measured again. It
ends beyond twice the distance from the point, as no entry there can be nearer. All points of a batch take a step at once.

Everything is counted in whole numbers, so results don't depend on the order or the number of partitions. Codebooks (a
few thousand numbers) and their sums are all that the driver sees; vectors stay where they are in every round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, releasing, stored

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Components are multiplied by this and floored.
SCALE = 1024
#: Larger whole components count as this, so that squared distances fit in 64 bits: vectors of up to 4096 components.
LARGEST = 1 << 24
#: Points that take their steps together, and entries that each of them looks at in a step.
TOGETHER, AHEAD = 1 << 13, 4


def usable(vector: str | Column = "embedding") -> Column:
    """True for vectors that aren't null or empty and hold finite components only; never null."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # NaN is more than infinite
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole_numbers(rows: DataFrame) -> DataFrame:
    """vec_id, label, ints (floor(1024 * x) of each component) of the usable rows."""
    ints = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(SCALE * x.cast("double"), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return rows.where(usable()).select("vec_id", "label", ints.alias("ints"))


class Codebook:
    """The entries of one part with the lists that the search walks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries = np.asarray(entries, dtype=np.int64)
        gaps = np.stack([((entries - e) ** 2).sum(1) for e in entries])
        self.lists = np.argsort(gaps, axis=1, kind="stable").astype(np.int32)
        self.reach = np.take_along_axis(gaps, self.lists.astype(np.int64), 1)
        self.starts = np.arange(0, len(entries), max(1, round(len(entries) ** 0.5)))

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every point and its squared distance; ties go to the lower index."""
        found, nearest = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for i in range(0, len(points), TOGETHER):
            found[i : i + TOGETHER], nearest[i : i + TOGETHER] = self._search(points[i : i + TOGETHER].astype(np.int64))
        return found, nearest

    def _search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entries, lists, reach, n, k = self.entries, self.lists, self.reach, len(points), len(self.entries)
        first = np.stack([((points - entries[s]) ** 2).sum(1) for s in self.starts], 1)
        at = first.argmin(1)
        best, now = first[np.arange(n), at], self.starts[at]  # argmin takes the first of equals
        seen = np.zeros((n, k), bool)
        seen[:, self.starts] = True
        place, active = np.zeros(n, np.int64), np.arange(n)
        while active.size:
            here = now[active]
            place_now = np.minimum(place[active, None] + np.arange(AHEAD), k - 1)
            entry = lists[here[:, None], place_now]
            near = reach[here[:, None], place_now] <= 4 * best[active, None]  # squares of distances; equality can be a tie
            rows, column = np.nonzero(near & ~seen[active[:, None], entry])
            of, e = active[rows], entry[rows, column]
            seen[of, e] = True
            d = ((points[of] - entries[e]) ** 2).sum(1)
            order = np.lexsort((e, d, of))  # the best of each point's entries
            of, e, d = of[order], e[order], d[order]
            lead = np.ones(len(of), bool)
            lead[1:] = of[1:] != of[:-1]
            of, e, d = of[lead], e[lead], d[lead]
            better = (d < best[of]) | ((d == best[of]) & (e < now[of]))
            of, e, d = of[better], e[better], d[better]
            place[active] += AHEAD
            now[of], best[of], place[of] = e, d, 0
            # A point whose list is at its end, or beyond twice the distance, is done unless it has jumped.
            ended = ~near[:, -1] | (place[active] >= k)
            jumped = np.zeros(n, bool)
            jumped[of] = True
            active = active[~ended | jumped[active]]
        return now, best


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _cut(vectors: np.ndarray, p: int) -> np.ndarray:
    width = vectors.shape[1] // PARTS
    return vectors[:, p * width : (p + 1) * width]


def _sums(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """part, entry, n, sums of the points nearest to each entry, one row for each in every task."""

    def run(batches):
        n = np.zeros((PARTS, len(books[0].entries)), np.int64)
        sums = np.stack([np.zeros_like(b.entries) for b in books])
        for batch in batches:
            vectors = _matrix(batch.column("ints"))
            for p, book in enumerate(books if len(vectors) else []):
                points = _cut(vectors, p)
                found, _ = book.search(points)
                n[p] += np.bincount(found, minlength=n.shape[1])
                np.add.at(sums[p], found, points)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "entry": entry.astype(np.int32), "n": n[part, entry], "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})

    return rows.select("ints").mapInArrow(releasing(run), "part int, entry int, n bigint, sums array<bigint>")


def train(rows: DataFrame) -> list[Codebook]:
    """Codebooks of whole_numbers' rows (stored, as each round reads them); [] if there are none.

    The first entries are those of the smallest ids; rows that repeat an id are taken by their components, null ids last.
    """
    seeds = [r.ints for r in rows.select("vec_id", "ints").orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).collect()]
    if not seeds:
        return []
    books = [Codebook(_cut(np.array(seeds), p)) for p in range(PARTS)]
    width = books[0].entries.shape[1]
    for _ in range(ROUNDS):
        total = _sums(rows, books).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
        entries = [b.entries.copy() for b in books]
        for r in total.collect():
            entries[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
        books = [Codebook(e) for e in entries]
    return books


def codes(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """vec_id, label, code (hex digits), error (squared distance from the entries named by the code)."""

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column("ints"))
            code, error = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), np.int64)
            for p, book in enumerate(books if len(vectors) else []):
                found, far = book.search(_cut(vectors, p))
                code[:, p] = found
                error += far
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(releasing(run), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error bigint")


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def decode(coded: DataFrame, books: list[Codebook]) -> DataFrame:
    """coded with `decoded`, the components that its code stands for (the entries' middle over SCALE)."""
    entries = [b.entries for b in books]

    def run(batches):
        for batch in batches:
            code = [bytes.fromhex(c) for c in batch.column("code").to_pylist()]
            vectors = [((np.concatenate([entries[p][c[p]] for p in range(PARTS)]) + 0.5) / SCALE).tolist() for c in code]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return coded.mapInArrow(releasing(run), StructType([*coded.schema.fields]).add("decoded", ArrayType(DoubleType())))


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of embeddings (vec_id, embedding, label).

    Null, empty and non-finite vectors are dropped; a length that isn't the first usable row's (the least one in numbers of
    ids) or isn't a multiple of PARTS raises ValueError. Fewer than 256 rows make fewer entries, none make no rows; repeated
    rows stay, each with its code; null labels are one label. Ties go to the lower entry.
    """
    rows = whole_numbers(embeddings)
    rows = stored(rows)
    lengths = rows.agg(F.min(F.size("ints")), F.max(F.size("ints"))).first()
    if lengths[0] != lengths[1] or (lengths[0] or 0) % PARTS:
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}: found {lengths[0]} to {lengths[1]}")
    books = train(rows)
    kind = dict(rows.dtypes)["vec_id"]
    if not books:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = stored(codes(rows, books).withColumn("same", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))))
    errors = coded.groupBy("same").agg(F.sum("error").alias("label_error"))
    return dealt_join(coded, errors, "same", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
