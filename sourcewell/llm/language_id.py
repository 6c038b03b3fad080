"""Language identification by compression.

Each language gets a zstandard raw-content dictionary of sampled labelled text. A text goes to the language whose
dictionary makes it smallest; where the two smallest sizes are too close, the decision is marked as rejected.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import learns, map_texts, releasing, slices

#: Bounds of the labelled sample: documents per language (by a hash of the id), characters taken from each of them (at a
#: place that the hash chooses), bytes of a dictionary, and bytes of all dictionaries, which share them evenly.
SAMPLE_DOCUMENTS = 256
SAMPLE_CHARACTERS = 1_000
DICTIONARY_BYTES, MODEL_BYTES = 64 << 10, 16 << 20
#: More labels than any set of languages has are refused: they are no languages then.
MOST_LABELS = 8_000
#: Long texts are compressed in blocks, so that a dictionary counts for more than a text's own repeats.
BLOCK_BYTES = 2048
#: Texts of fewer bytes are compressed at a higher level, as three copies: their first copy alone gains too little.
SHORT_BYTES = 400
#: Rejected below this relative distance of the two smallest sizes.
MIN_MARGIN = 0.005

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _words():
    import regex

    return regex.compile(r"\p{L}+")


def normalised(text: str | None) -> bytes:
    """Lower-cased letter runs of the whole text, one blank apart: case, digits and signs say little of the language."""
    return " ".join(_words().findall((text or "").lower())).encode()


def train(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> tuple[tuple[str, bytes], ...]:
    """(language, dictionary) pairs, most frequent language first, from rows of docs (doc_id, text, lang).

    Rows without text or lang don't count. Every label that occurs gets a dictionary. Ids are ranked first, without their
    texts; then only the sampled texts are read. The sample is bounded by this module's constants.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS + 1).collect()}
    langs = list(counts)
    if not langs:
        return ()
    if len(langs) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different labels in lang")
    size = min(size, MODEL_BYTES // len(langs))
    sample = min(sample, max(4, 4 * size // SAMPLE_CHARACTERS))
    # Keys are evenly spread below 2 ** 30: a bound for each language lets about four times the sample through to the ranking.
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 34)
    limits = docs.sparkSession.createDataFrame([(lang, min(1 << 30, -(-(4 * sample + 64 << 30) // n))) for lang, n in counts.items()], "lang string, bound long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    near = known.select("doc_id", "lang", key.alias("key")).join(F.broadcast(limits), "lang").where("key < bound")  # at most MOST_LABELS rows
    ids = near.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang")
    # The sampled ids are bounded; a document that isn't among them doesn't travel.
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARACTERS + 1)).cast("int") + 1
    texts = known.join(F.broadcast(ids.distinct()), ["doc_id", "lang"], "left_semi").select("lang", F.xxhash64("doc_id").alias("key"), "doc_id", F.substring("text", start, F.lit(SAMPLE_CHARACTERS)).alias("text"))
    content: dict[str, bytes] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.key, r.doc_id, r.text)):
        if len(content.setdefault(r.lang, b"")) < size:
            content[r.lang] += normalised(r.text) + b" "
    return tuple((lang, content.get(lang, b"")[:size]) for lang in langs)


@lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list[tuple]:
    import zstandard as z

    out = []
    for _, content in model:
        pair = []
        for level in (5, 9):
            params = z.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
            words = z.ZstdCompressionDict(content or b"        ", dict_type=z.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            pair.append(z.ZstdCompressor(dict_data=words, compression_params=params) if level == 9 else z.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
        out.append(tuple(pair))
    return out


def sizes(data: bytes, model: tuple[tuple[str, bytes], ...]) -> list[int]:
    """Compressed size of normalised text under each language's dictionary."""
    if len(data) < SHORT_BYTES:
        thrice = (data + b" ") * 3
        return [len(short.compress(thrice)) for _, short in _compressors(model)]
    blocks = [data[a : a + BLOCK_BYTES] for a in range(0, len(data), BLOCK_BYTES)]
    return [sum(len(x) for x in map(long.compress, blocks)) for long, _ in _compressors(model)]


def classify(text: str | None, model: tuple[tuple[str, bytes], ...], min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
    """Language, score, margin and whether the decision is rejected."""
    data = normalised(text)
    if not data or not model:
        return UNKNOWN, 0.0, 0.0, True
    found = sizes(data, model)
    best = min(range(len(found)), key=lambda k: (found[k], k))
    second = min((x for k, x in enumerate(found) if k != best), default=2 * found[best])
    margin = (second - found[best]) / second
    score = 1 / sum(math.exp(-min(500.0, (x - found[best]) / 2)) for x in found)
    return model[best][0], score, margin, margin < min_margin


def identify(docs: DataFrame, model: tuple[tuple[str, bytes], ...], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected for each row of docs (doc_id, text).

    lang_pred is a language of the model; it is 'und', with score 0 and rejected, if the text is null or has no
    letter or the model is empty. Equal sizes go to the language with more training documents and are rejected.
    Repeated rows are decided each; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, list]:
        own = shared.value
        found = [classify(t, own, min_margin) for t in rows["text"]]
        lang, score, margin, rejected = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
        return {"doc_id": rows["doc_id"], "lang_pred": lang, "score": score, "margin": margin, "rejected": rejected}

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def train_and_identify(docs: DataFrame) -> DataFrame:
    """identify() for all rows of docs (doc_id, text, lang), trained on those that may be learned from; adds held_out."""
    model = train(docs.where(learns()))
    return identify(docs, model).withColumn("held_out", ~learns()).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def keep_identified(docs: DataFrame, model: tuple[tuple[str, bytes], ...], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text classify() doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            keep = [not classify(t, own, min_margin)[3] for part in slices(batch, "text") for t in part.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(releasing(run, _compressors.cache_clear), docs.schema)  # workers are used for later stages
