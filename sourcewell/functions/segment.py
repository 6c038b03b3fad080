"""Words of Chinese text: the best path through the graph of a lexicon's words, by dynamic programming over log frequencies.

Equal runs of characters are segmented once. A lexicon of up to LEXICON_BYTES travels to the tasks; a larger one meets the
runs' character groups in a join, so that each run comes with just the words that it holds.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import CJK

#: Bytes of a lexicon that tasks hold whole, and characters of its longest words.
LEXICON_BYTES, LONGEST = 16 << 20, 8
#: Scores are whole millionths of a natural logarithm: sums don't depend on their order, and ties are ties.
UNIT = 1_000_000


def best_path(run: str, scores: Mapping[str, int], unknown: int, longest: int = LONGEST) -> list[str]:
    """The words of the path with the highest sum of scores; of equal paths that with the longest first words. A character
    without a score of its own is a word with the score `unknown`."""
    n = len(run)
    best, ends = [0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        best[i], ends[i] = max((s + best[j], j) for j in range(i + 1, min(n, i + longest) + 1) if (s := scores.get(run[i:j], unknown if j == i + 1 else None)) is not None)
    out, i = [], 0
    while i < n:
        out.append(run[i : ends[i]])
        i = ends[i]
    return out


def runs(texts: DataFrame, column: str = "text") -> DataFrame:
    """run, n: the distinct runs of Chinese characters and how often each occurs."""
    found = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(f"[{CJK}]+"), F.lit(0))).alias("run"))
    return found.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _groups(longest: int):
    """Every group of up to `longest` characters of column run."""
    size = F.length("run")
    return F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda k: F.substring("run", i, k))))


def lexicon_of(texts: DataFrame, column: str = "text", longest: int = 4, min_count: int = 2) -> DataFrame:
    """word, freq: groups of characters that occur at least min_count times in texts, as a first lexicon of a corpus."""
    words = runs(texts, column).select(F.explode(_groups(longest)).alias("word"), "n")
    return words.groupBy("word").agg(F.sum("n").alias("freq")).where(F.col("freq") >= min_count)


def scored(lexicon: DataFrame, custom: Mapping[str, int | None] | None = None) -> tuple[DataFrame, int]:
    """word, score of a lexicon (word, freq) with custom words, and the score of unknown characters.

    A custom word replaces the lexicon's; without a frequency (None) it gets just enough to be kept whole. Words of more
    than LONGEST characters and frequencies under one are left out; repeated words add up.
    """
    custom = dict(custom or {})
    rows = lexicon.where((F.col("freq") >= 1) & F.length("word").between(1, LONGEST)).groupBy("word").agg(F.sum("freq").cast("double").alias("freq"))
    total = (rows.agg(F.sum("freq")).first()[0] or 0.0) + sum(f for f in custom.values() if f)
    total = max(total, 1.0)
    table = rows.select("word", F.round(UNIT * (F.log("freq") - math.log(total))).cast("bigint").alias("score"))
    unknown = round(UNIT * -math.log(total))
    if custom:
        own = {w: round(UNIT * (math.log(f) - math.log(total))) for w, f in custom.items() if f}
        parts = {w[i:j] for w in custom for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        known = {r.word: r.score for r in table.where(F.col("word").isin(*sorted(parts))).collect()} | own  # parts of the caller's words
        for w in (w for w, f in custom.items() if not f):
            split = best_path(w, {k: s for k, s in known.items() if k != w}, unknown)
            own[w] = max(known.get(w, unknown - 1), sum(known.get(x, unknown) for x in split) + 1)
        extra = lexicon.sparkSession.createDataFrame(sorted(own.items()), "word string, score bigint")
        table = table.join(extra, "word", "left_anti").unionByName(extra)
    return table, unknown


def segmented(runs: DataFrame, lexicon: DataFrame, custom: Mapping[str, int | None] | None = None) -> DataFrame:
    """runs with `words`, the best path of column run. An empty lexicon makes each character a word."""
    table, unknown = scored(lexicon, custom)
    size, longest = table.agg(F.sum(F.octet_length("word") + 16), F.max(F.length("word"))).first()
    longest = longest or 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", words array<string>"
    names = runs.columns

    def result(batch: pa.RecordBatch, words: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(words, pa.list_(pa.string()))], [*names, "words"])

    if (size or 0) <= LEXICON_BYTES:
        scores = {r.word: r.score for r in table.collect()}
        shared = runs.sparkSession.sparkContext.broadcast(scores)

        def whole(batches):
            for batch in batches:
                yield result(batch, [best_path(r, shared.value, unknown, longest) for r in batch.column("run").to_pylist()])

        return runs.mapInArrow(whole, schema)
    held = runs.select("run").distinct().select("run", F.explode(F.array_distinct(_groups(longest))).alias("word")).join(table, "word").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", "score"))).alias("held"))

    def own(batches):
        for batch in batches:
            yield result(batch, [best_path(r, dict(held or ()), unknown, longest) for r, held in zip(batch.column("run").to_pylist(), batch.column("held").to_pylist(), strict=True)])

    return runs.join(held, "run", "left").mapInArrow(own, schema)
