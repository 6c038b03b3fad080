"""Many terms in one pass over each text: an Aho-Corasick automaton in Arrow batches.

A scan's time is that of the text and its hits, however many terms there are. Terms of up to TERM_BYTES travel to the
tasks as they are; more are cut into blocks by hash, and texts are scanned once for each block.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Bytes of terms that one automaton holds.
TERM_BYTES = 8 << 20
#: So few terms are looked for one by one, which is faster.
FEW = 16


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(term, (i, len(term)))
    out.make_automaton()
    return out


def count_terms(text: str, terms: tuple[str, ...]) -> dict[str, int]:
    """How often each term that occurs is in a text, each counted from the left without overlaps."""
    if len(terms) <= FEW:
        return {term: n for term in terms if (n := text.count(term))}
    ends: dict[int, int] = {}
    counts: dict[int, int] = {}
    for end, (i, length) in _automaton(terms).iter(text) if terms else ():
        if end - length >= ends.get(i, -1):
            ends[i] = end
            counts[i] = counts.get(i, 0) + 1
    return {terms[i]: n for i, n in counts.items()}


def term_blocks(terms: DataFrame, column: str = "term") -> list[tuple[str, ...]]:
    """The distinct non-empty terms in blocks of TERM_BYTES or less, cut by hash; each is the size of one automaton."""
    distinct = terms.select(F.col(column).alias("term")).where("term <> ''").distinct()
    size = distinct.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = -(-size // TERM_BYTES)
    if blocks <= 1:
        return [tuple(sorted(r.term for r in distinct.collect()))]
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(2 * blocks)))
    return [tuple(sorted(r.term for r in dealt.where(F.col("block") == b).select("term").collect())) for b in range(2 * blocks)]


def with_counts(texts: DataFrame, blocks: list[tuple[str, ...]], columns: list[str]) -> DataFrame:
    """texts with `found`: for each term that occurs in one of the columns an array of its counts in each of them.

    One row comes for each block of terms. Null texts hold no terms.
    """

    def scan(terms: tuple[str, ...]):
        def run(batches):
            for batch in batches:
                counts = [[count_terms(t, terms) if t else {} for t in batch.column(c).to_pylist()] for c in columns]
                found = [[{"term": t, "n": [c.get(t, 0) for c in row]} for t in dict.fromkeys(t for c in row for t in c)] for row in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.struct([("term", pa.string()), ("n", pa.list_(pa.int32()))])))], [*batch.schema.names, "found"])

        return run

    one = StructType([StructField("term", StringType()), StructField("n", ArrayType(IntegerType()))])
    schema = StructType([*texts.schema.fields, StructField("found", ArrayType(one))])
    out = [texts.mapInArrow(scan(terms), schema) for terms in blocks]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def term_sums(texts: DataFrame, terms: DataFrame, by: list[str], spaceless: bool = False) -> DataFrame:
    """by, term, n: occurrences of each term in column text of a group's rows; groups are columns of texts. With spaceless, a
    text counts for a term what it holds with or without all blanks, whichever is more. Sums leave a task, not hits."""
    kept = texts.select(*by, "text")
    schema = StructType([*kept.drop("text").schema.fields, StructField("term", StringType()), StructField("n", LongType())])

    def scan(own: tuple[str, ...]):
        joint = {t: t.replace(" ", "") for t in own}
        spaced: dict[str, list[str]] = {}
        for t, j in joint.items():
            spaced.setdefault(j, []).append(t)
        close = tuple(sorted(spaced.keys() - {""}))

        def run(batches):
            for batch in batches:
                sums: dict[tuple, int] = {}
                for *key, text in zip(*(batch.column(c).to_pylist() for c in [*by, "text"]), strict=True):
                    counts = count_terms(text, own) if text else {}
                    if text and spaceless:
                        for j, n in count_terms(text.replace(" ", ""), close).items():
                            for t in spaced[j]:
                                counts[t] = max(counts.get(t, 0), n)
                    for t, n in counts.items():
                        sums[(*key, t)] = sums.get((*key, t), 0) + n
                columns = [*zip(*(k for k in sums), strict=True)] if sums else [[]] * (len(by) + 1)
                types = [batch.schema.field(c).type for c in by] + [pa.string()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(list(sums.values()), pa.int64())], [*by, "term", "n"])

        return run

    out = [kept.mapInArrow(scan(block), schema) for block in term_blocks(terms)]
    rows = out[0]
    for df in out[1:]:
        rows = rows.unionByName(df)
    return rows.groupBy(*by, "term").agg(F.sum("n").alias("n"))
