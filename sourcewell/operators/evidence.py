"""Evidence quality on seven dimensions, artifacts, evidence units, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.times import published
from .collect import blank

DIMENSIONS = ("relevance", "directness", "integrity", "extraction", "credibility", "independence", "freshness")
LOW_CONFIDENCE = 0.65


def dimension_label(x: Column) -> Column:
    return F.when(x >= 0.8, "strong").when(x >= 0.6, "moderate").when(x >= 0.35, "weak").otherwise("insufficient")


def evidence_quality(sources: DataFrame, start: str | None = None, end: str | None = None, claim: str | None = None) -> DataFrame:
    """sources plus the seven dimensions, their mean and a label.

    Read where present, else absent: claim text, relevance (0-100), modality, transcript, n_comments, has_hash,
    has_location, url, asr_confidence, ocr_confidence, sponsored, verified, creator, independence, duplicate, cluster,
    published. start and end are days of the research window.
    """
    has = set(sources.columns)
    get = lambda name, kind: F.col(name).cast(kind) if name in has else F.lit(None).cast(kind)
    true = lambda name: F.coalesce(get(name, "boolean"), F.lit(False))
    modality, ranked = get("modality", "string"), get("relevance", "double")
    if claim:
        wanted, found = t.terms(F.lit(claim)), t.terms(F.concat_ws(" ", *(get(x, "string") for x in ("title", "summary", "transcript"))))
        overlap = F.size(F.array_intersect(wanted, found)) / F.greatest(F.size(wanted), F.lit(1))
        relevance = F.least(F.lit(1.0), 1.5 * overlap)
    else:
        relevance = F.when(F.coalesce(ranked, F.lit(0.0)) != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ranked / 100))).otherwise(0.65)
    spoken = ~blank(get("transcript", "string"))
    directness = (
        F.when(modality.isin("speech", "subtitle"), 0.9).when(modality == "ocr", 0.8).when(modality == "comment", 0.55)
        .when(spoken, 0.75).when(F.coalesce(get("n_comments", "int"), F.lit(0)) > 0, 0.45).otherwise(0.25)
    )
    integrity = F.when(true("has_hash") & true("has_location"), 0.95).when(true("has_hash"), 0.7).when(~blank(get("url", "string")), 0.4).otherwise(0.15)
    parsed = F.when(modality.isin("text", "comment", "metadata"), 0.85).when(spoken, 0.6).otherwise(0.5)
    extraction = F.coalesce(get("asr_confidence", "double"), get("ocr_confidence", "double"), parsed)
    credibility = F.when(true("sponsored"), 0.35).when(true("verified"), 0.85).when(~blank(get("creator", "string")), 0.65).otherwise(0.35)
    known = get("independence", "double")
    independence = F.when(known.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), known))).when(true("duplicate"), 0.2).when(~blank(get("cluster", "string")), 0.7).otherwise(0.5)
    day = published(get("published", "string"))
    inside = F.lit(0.9) if start or end else F.lit(0.7)
    freshness = F.when(day.isNull(), 0.5)
    if start:
        freshness = freshness.when(day < F.lit(start).cast("timestamp"), 0.2)
    if end:
        freshness = freshness.when(day > F.lit(end).cast("timestamp") + F.expr("interval 1 day - interval 1 second"), 0.2)
    values = dict(zip(DIMENSIONS, (relevance, directness, integrity, extraction, credibility, independence, freshness.otherwise(inside)), strict=True))
    out = sources.withColumns({f"d_{n}": v.cast("double") for n, v in values.items()})
    mean = sum((F.col(f"d_{n}") for n in DIMENSIONS[1:]), F.col("d_relevance")) / len(DIMENSIONS)
    label = (
        F.when(F.col("d_relevance") < 0.35, "Insufficient")
        .when((F.col("mean") >= 0.78) & (F.least("d_directness", "d_integrity") >= 0.6), "Strong")
        .when(F.col("mean") >= 0.58, "Moderate").when(F.col("mean") >= 0.38, "Weak").otherwise("Insufficient")
    )
    return out.withColumn("mean", mean).withColumn("label", label).withColumn("dimensions", F.struct(*(dimension_label(F.col(f"d_{n}")).alias(n) for n in DIMENSIONS)))


def label_counts(assessed: DataFrame) -> DataFrame:
    """Sources of each run and label, with comments, with transcripts."""
    return assessed.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_comments") > 0).alias("with_comments"), F.count_if(~blank("transcript")).alias("with_transcripts"))


def artifacts(sources: DataFrame, columns: list[str]) -> DataFrame:
    """source_id, artifact_id, content_hash: sha256 of the named columns as canonical JSON, keys in order."""
    text = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))
    hashed = F.sha2(text, 256)
    return sources.select("source_id", F.concat(F.lit("artifact-"), F.col("source_id").cast("string"), F.lit("-"), F.substring(hashed, 1, 12)).alias("artifact_id"), hashed.alias("content_hash"), text.alias("raw_data"))


def evidence_units(sources: DataFrame, most: int = 1600) -> DataFrame:
    """source_id, modality and text: one unit a source from transcript, summary, title and comments (array), if any."""
    text = F.substring(F.array_join(F.filter(F.concat(F.array("transcript", "summary", "title"), F.slice("comments", 1, 3)), lambda x: F.coalesce(x, F.lit("")) != ""), "\n"), 1, most)
    return sources.select("source_id", F.when(~blank("transcript"), "speech").otherwise("text").alias("modality"), text.alias("text")).where("text != ''")


def transcript_units(segments: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """A unit for each segment (source_id, pos, text, start_ms, end_ms, asr_confidence) with text: id, text hash and
    review_status, low_confidence below the threshold."""
    clean = t.squeeze(t.strip("text"))
    key = F.concat_ws("|", F.col("source_id").cast("string"), F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), clean)
    return segments.where(clean != "").select(
        "source_id", "start_ms", "end_ms", "asr_confidence", F.concat(F.lit("unit-"), F.substring(F.sha2(key, 256), 1, 16)).alias("unit_id"), F.sha2(clean, 256).alias("content_hash"),
        F.when(F.col("asr_confidence") < threshold, "low_confidence").otherwise("unreviewed").alias("review_status"),
    )


def transcript_chunks(sources: DataFrame, size: int = 1600, most: int = 12_000, count: int = 8) -> DataFrame:
    """source_id, chunk (from 0) and text: the pieces of each transcript."""
    return sources.select("source_id", F.posexplode(t.chunks("transcript", size, most, count)).alias("chunk", "text"))


def register_chunks(spark: SparkSession) -> None:
    """The same pieces as a table function for SQL: select s.*, c.* from sources s, lateral transcript_chunks(s.transcript) c.

    An SQL function, so a text stays in the JVM and the plan is one generator; null and empty texts give no rows.
    """
    spark.sql("""create or replace temporary function transcript_chunks(body string, size int default 1600, most int default 12000, pieces int default 8)
        returns table (chunk int, text string)
        return select pos, col from posexplode(filter(transform(sequence(0, greatest(0, pieces - 1)), i -> substring(substring(coalesce(body, ''), 1, most), i * size + 1, size)), (x, i) -> i < pieces and x != ''))""")


def attach_transcript(sources: DataFrame, segments: DataFrame, preview: int = 420) -> DataFrame:
    """sources with transcript and transcript_preview joined from their segments in order; blank ones don't count."""
    clean = segments.withColumn("text", t.squeeze(t.strip("text"))).where("text != ''")
    joined = clean.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("transcript"))
    return sources.drop("transcript").join(joined, "source_id", "left").withColumn("transcript_preview", F.substring("transcript", 1, preview))


def reusable_transcripts(media: DataFrame, done: DataFrame) -> DataFrame:
    """media (content_hash) that done has no transcript of; media may be a stream."""
    return media.join(done.select("content_hash").distinct(), "content_hash", "left_anti")


def asr_candidates(ranked: DataFrame, top_n: int) -> DataFrame:
    """Sources with an address among the first top_n (5 at most) of each run."""
    return ranked.where((~blank("url")) & (F.col("display_id") <= min(5, max(0, top_n))))
