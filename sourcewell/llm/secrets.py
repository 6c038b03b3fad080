"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Two first-order character Markov models, one of random strings and one of
ordinary identifiers, are counted from labelled samples; a long run of key characters is a secret too if its
log-likelihood ratio favours the random model. Nothing here runs Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA and what follows are at least 16 characters
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the Markov models judge, and the characters they know.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents of the labelled sample, those with the smallest hash of the id.
SAMPLE_DOCUMENTS = 2_000
#: A run is a secret from this log-likelihood ratio on, in all and for each step, and this number of distinct characters.
MIN_RATIO, MIN_RATIO_STEP, MIN_DISTINCT = 20.0, 0.8, 10

#: Weight of a character's overall frequency in the models' steps.
BACK_OFF = 5.0

_SPANS = "array<struct<s:int,k:int,e:int>>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(pattern: str, kind: int, keep: str = "true", group: int = 0) -> Column:
    """Spans of the matches of a pattern in column `text`; keep is a condition on x.val, the group's text.

    The lengths of the pieces between matches and of the matches add up to offsets in code points.
    """
    p = _sql(pattern)
    return F.expr(f"""
      case when text rlike {p} then
        transform(array(struct(split(text, {p}, -1) as gaps, regexp_extract_all(text, {p}, 0) as hits, regexp_extract_all(text, {p}, {group}) as vals)), t ->
          aggregate(
            transform(t.hits, (x, i) -> struct(length(get(t.gaps, i)) as gap, length(x) as hit, get(t.vals, i) as val)),
            struct(0 as at, cast(array() as {_SPANS}) as found),
            (acc, x) -> struct(
              acc.at + x.gap + x.hit as at,
              if({keep}, array_append(acc.found, struct(acc.at + x.gap as s, {kind} as k, acc.at + x.gap + x.hit as e)), acc.found) as found),
            acc -> acc.found))[0]
      else cast(array() as {_SPANS}) end""")


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (with column text) plus one array of spans (s, k, e) for each base kind."""
    return (
        docs.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("assign", _found(ASSIGN, 0, f"length(x.val) >= {ASSIGN_MIN}", 2))
        .withColumn("access", _found(ACCESS, 1))
        .withColumn("hex", _found(HEX, 2))
    )


def labelled_samples(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """value, random (boolean): a bounded sample. Random ones are what the base patterns find in the sampled
    documents, and hashes of their ids in three spellings; ordinary ones are the shorter runs of those documents, which
    are never judged."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    digest = F.sha2(F.concat(F.lit("random "), F.col("doc_id").cast("string")), 256)
    spelled = F.array(F.base64(F.unhex(digest)), digest, F.upper(F.translate(F.base64(F.unhex(digest)), "+/=", "")))
    hashed = ids.select(F.explode(spelled).alias("value"), F.lit(True).alias("random"))
    texts = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    base = f"(?:{ASSIGN.removeprefix('(?i)')})|(?:{ACCESS})|(?:{HEX})"
    found = texts.select(F.explode(F.expr(f"concat(filter(regexp_extract_all(text, {_sql(ASSIGN)}, 2), x -> length(x) >= {ASSIGN_MIN}), regexp_extract_all(text, {_sql(ACCESS)}, 0), regexp_extract_all(text, {_sql(HEX)}, 0))")).alias("value"), F.lit(True).alias("random"))
    plain = texts.select(F.explode(F.expr(f"filter(regexp_extract_all(regexp_replace(text, {_sql(base)}, ' '), '[A-Za-z0-9+/_=-]{{4,}}', 0), x -> length(x) < 20)")).alias("value"), F.lit(False).alias("random"))
    return hashed.unionByName(found).unionByName(plain)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step between two characters of ALPHABET, row by row, from value, random."""
    pairs = samples.select("random", F.explode(F.expr("transform(sequence(1, greatest(length(value) - 1, 1)), i -> substring(value, i, 2))")).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect()}
    ratios = {}
    for label in (True, False):
        singles = {b: sum(counts.get((label, a + b), 0) for a in ALPHABET) + 0.5 for b in ALPHABET}
        total = sum(singles.values())
        for a in ALPHABET:
            n = sum(counts.get((label, a + b), 0) for b in ALPHABET) + BACK_OFF
            for b in ALPHABET:
                ratios[label, a + b] = math.log((counts.get((label, a + b), 0) + BACK_OFF * singles[b] / total) / n)
    return [ratios[True, a + b] - ratios[False, a + b] for a in ALPHABET for b in ALPHABET]


def _ratio(table: list[float]) -> str:
    """SQL for the summed ratio of the run `x`; the table and the character numbers are literals, folded once."""
    numbers = {ord(c): i for i, c in enumerate(ALPHABET)}
    index = "cast(split('" + ",".join(str(numbers.get(c, 0)) for c in range(128)) + "', ',') as array<int>)"
    values = "cast(split('" + ",".join(f"{v:.4f}" for v in table) + "', ',') as array<double>)"
    at = lambda i: f"get({index}, ascii(substring(x, {i}, 1)))"
    return f"aggregate(sequence(1, length(x) - 1), 0D, (acc, i) -> acc + get({values}, {at('i')} * {len(ALPHABET)} + {at('i + 1')}))"


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """docs plus assign, access, hex and markov: arrays of spans (s, k, e) in code points, e exclusive.

    A null text counts as empty (and comes back empty); it has no spans. Markov spans never overlap base spans.
    Texts of any length are read whole; repeated rows are scanned each; an empty table gives no rows.
    """
    keep = f"size(array_distinct(split(x.val, ''))) >= {MIN_DISTINCT} and transform(array(x.val), x -> {_ratio(table)} >= greatest({MIN_RATIO}D, {MIN_RATIO_STEP}D * (length(x) - 1)))[0]"
    clear = "filter(m.runs, r -> not exists(m.base, b -> b.s < r.e and r.s < b.e))"
    return (
        base_spans(docs)
        .withColumn("runs", _found(RUN, 3, keep))
        .withColumn("markov", F.expr(f"transform(array(struct(runs, concat(assign, access, hex) as base)), m -> {clear})[0]"))
        .drop("runs")
    )


def _joined(*kinds: str) -> Column:
    names = "array(" + ", ".join(_sql(k) for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort(concat({', '.join(kinds)})), x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')")


def report(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = scan(docs, train(labelled_samples(docs)) if table is None else table)
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(*KINDS[:3]), 256).alias("base_sha256"),
        _joined(*KINDS).alias("spans"),
    )


def redact(docs: DataFrame, table: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret span of text replaced by a mark; overlapping spans are replaced together. Texts without
    secrets, null ones included, and all other columns stay as they are."""
    own = docs.columns
    found = scan(docs.select(F.col("text"), F.struct(*own).alias("row")), table)
    merged = f"""aggregate(array_sort(concat({", ".join(KINDS)})), cast(array() as array<struct<s:int,e:int>>), (acc, x) ->
        if(size(acc) > 0 and x.s < element_at(acc, -1).e,
           concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s as s, greatest(element_at(acc, -1).e, x.e) as e))),
           array_append(acc, struct(x.s as s, x.e as e))))"""
    clean = f"""transform(array({merged}), m -> if(size(m) = 0, row.text, concat(
        array_join(transform(m, (x, i) -> concat(substring(text, if(i = 0, 1, get(m, i - 1).e + 1), x.s - if(i = 0, 0, get(m, i - 1).e)), {_sql(mark)})), ''),
        substring(text, element_at(m, -1).e + 1))))[0]"""
    return found.select("row", F.expr(clean).alias("clean")).select(*(F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own))
