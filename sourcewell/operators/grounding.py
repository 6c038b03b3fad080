"""Claims against evidence: lexical containment with polarity, verdicts, citations to units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .collect import first_by, top_by

MIN_OVERLAP = 0.3
#: Moments and units meet by spans of so many milliseconds.
SPAN_MS = 60_000


def claim_overlap(claims: DataFrame, units: DataFrame, threshold: float = MIN_OVERLAP, term_sets: tuple[Column, Column] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """claim_id, unit_id, shared, overlap, agrees: pairs whose units hold at least that share of the claim's terms; with
    `by`, columns of both tables, only pairs that are equal in them.

    A unit's terms are made once. Those that some claim has meet the claims' terms, and a pair's shared terms are
    counted as they are met, in parts before the shuffle; no list of terms is stored or sent with a pair.
    """
    mine, theirs = term_sets or (t.terms("claim_text"), t.terms("text"))
    keys = [*by, "term"]
    c = claims.select(*by, "claim_id", mine.alias("terms"), t.has_negation("claim_text").alias("negative")).where(F.size("terms") > 0)
    each = c.select(*by, "claim_id", "negative", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    # Terms and negation are made below the generator, once a unit.
    u = units.select(*by, "unit_id", t.has_negation("text").alias("unit_negative"), theirs.alias("unit_terms"))
    u = u.select(*by, "unit_id", "unit_negative", F.explode("unit_terms").alias("term"))
    pairs = u.join(each, keys).groupBy("claim_id", "unit_id", "n", "negative", "unit_negative").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    return pairs.select("claim_id", "unit_id", "shared", (F.col("shared") / F.col("n")).alias("overlap"), (F.col("negative") == F.col("unit_negative")).alias("agrees")).where(F.col("overlap") >= threshold)


def linked_units(claims: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """claim_id, unit_id: the units of a claim's links, or, if none of them exists, of its own unit_ids."""
    known = units.select("unit_id")
    by_link = links.select("claim_id", "unit_id").join(known, "unit_id", "left_semi")
    own = claims.select("claim_id", F.explode("unit_ids").alias("unit_id")).join(known, "unit_id", "left_semi")
    return by_link.unionByName(own.join(by_link, "claim_id", "left_anti")).select("claim_id", "unit_id").distinct()


def verdicts(claims: DataFrame, pairs: DataFrame, links: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """Verdict on each claim (claim_id): relation, n_support, n_contradict, confidence and needs_review.

    pairs: claim_id, unit_id, overlap, agrees of the units with enough overlap; links: claim_id, unit_id, relation;
    best: claim_id, overlap of the units without enough, which only bounds the confidence of claims without verdict.
    """
    rows = pairs.select("claim_id", "unit_id", F.when(F.col("agrees"), "support").otherwise("contradict").alias("relation"), "overlap")
    if links is not None:
        rows = rows.unionByName(links.where(F.col("relation").isin("support", "contradict")).select("claim_id", "unit_id", "relation", F.lit(None).cast("double").alias("overlap")))
    if best is not None:
        rows = rows.unionByName(best.select("claim_id", F.lit(None).cast(pairs.schema["unit_id"].dataType).alias("unit_id"), F.lit("none").alias("relation"), "overlap"))
    distinct = rows.groupBy("claim_id", "relation", "unit_id").agg(F.max("overlap").alias("overlap"))
    agg = distinct.groupBy("claim_id").agg(
        F.count_if(F.col("relation") == "support").alias("n_support"), F.count_if(F.col("relation") == "contradict").alias("n_contradict"), F.coalesce(F.max("overlap"), F.lit(0.0)).alias("most")
    )
    all_claims = claims.select("claim_id").join(agg, "claim_id", "left").fillna({"n_support": 0, "n_contradict": 0, "most": 0.0})
    s, x, m = F.col("n_support"), F.col("n_contradict"), F.col("most")
    mixed = (s > 0) & (x > 0)
    confidence = (
        F.when(mixed, F.least(F.lit(0.9), 0.55 + 0.08 * (s + x)))
        .when(x > 0, F.least(F.lit(0.95), 0.62 + 0.08 * x + 0.15 * m))
        .when(s > 0, F.least(F.lit(0.95), 0.58 + 0.08 * s + 0.2 * m))
        .otherwise(F.greatest(F.lit(0.05), F.least(F.lit(0.45), m)))
    )
    relation = F.when(x > 0, "contradict").when(s > 0, "support").otherwise("insufficient")
    out = all_claims.select("claim_id", relation.alias("relation"), "n_support", "n_contradict", F.round(confidence, 3).alias("confidence"), mixed.alias("mixed"))
    return out.withColumn("needs_review", (F.col("relation") == "insufficient") | F.col("mixed") | (F.col("confidence") < 0.65)).drop("mixed")


def verify(claims: DataFrame, units: DataFrame, links: DataFrame, verifier: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Verdicts on claims against their own units; verifier, if given, judges each claim's rows as a pandas frame.

    A claim has few units of its own, which bounds the frames; schema is the verifier's result.
    """
    own = linked_units(claims, links, units)
    rows = own.join(claims.select("claim_id", "claim_text"), "claim_id").join(units.select("unit_id", "text"), "unit_id")
    if verifier is not None:
        return rows.groupBy("claim_id").applyInPandas(verifier, schema)
    mine, theirs = t.terms("claim_text"), t.terms("text")
    shared = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(mine), F.lit(1))
    scored = rows.select("claim_id", "unit_id", shared.alias("overlap"), (t.has_negation("claim_text") == t.has_negation("text")).alias("agrees"))
    return verdicts(claims, scored.where(F.col("overlap") >= MIN_OVERLAP), links, scored.groupBy("claim_id").agg(F.max("overlap").alias("overlap")))


def relation_counts(judged: DataFrame, by: list[str]) -> DataFrame:
    """Claims of each relation."""
    return judged.groupBy(*by).agg(*(F.count_if(F.col("relation") == r).alias(r) for r in ("support", "contradict", "insufficient")))


def dedupe_claims(claims: DataFrame, most: int = 12) -> DataFrame:
    """The first claim (run_id, pos, claim_text) of each text, white space squeezed and in lower case; most of a run."""
    keyed = claims.withColumn("claim_text", t.squeeze(t.strip("claim_text"))).withColumn("key", F.lower("claim_text")).where("claim_text != ''")
    return top_by(first_by(keyed, ["run_id", "key"], [F.col("pos")]), ["run_id"], [F.col("pos")], most).drop("key")


def resolve_citations(citations: DataFrame, units: DataFrame) -> DataFrame:
    """citation_id, unit_id of the unit (source_id, unit_id, pos, start_ms, end_ms, comment_id, frame_index) that each
    citation (citation_id, source_id, cited: parsed) means; null if none does.

    Comments and frames match by number, moments by the overlapping unit with the nearest start, whole sources by the
    first unit. One equi-join on the source and a key: a number, a mark of first units, or one of the spans of SPAN_MS
    that a moment and a unit reach into.
    """
    none = F.array().cast("array<string>")
    spans = lambda start, end: F.transform(F.sequence(F.floor(start / SPAN_MS), F.floor(F.greatest(start, end) / SPAN_MS)), lambda i: F.concat(F.lit("t:"), i.cast("string")))
    named = lambda mark, x: F.when(x.isNotNull(), F.array(F.concat(F.lit(mark), x.cast("string")))).otherwise(none)
    a, kind = F.col("a"), F.col("a.kind")
    until = F.coalesce(a["end_ms"], a["start_ms"])
    keys = F.when(kind == "comment", named("c:", a["comment_id"])).when(kind == "frame", named("f:", a["frame_index"])).when(kind == "source", F.array(F.lit("s"))).when((kind == "timestamp") & a["start_ms"].isNotNull(), spans(a["start_ms"], until)).otherwise(none)
    # The parsed citation goes through a generator, so that it is parsed once and not once for each of its fields.
    parsed = citations.select("citation_id", "source_id", F.explode(F.array("cited")).alias("a"))
    cited = parsed.select("citation_id", "source_id", a["start_ms"].alias("from"), until.alias("to"), F.explode(keys).alias("key"))
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    found = F.concat(named("c:", F.col("comment_id")), named("f:", F.col("frame_index")), F.when(timed, spans(F.col("start_ms"), F.col("end_ms"))).otherwise(none))
    row = F.struct("pos", "unit_id").alias("u")
    first = units.groupBy("source_id").agg(F.min(row).alias("u")).select("source_id", F.lit("s").alias("key"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), "u")
    known = units.select("source_id", F.explode(found).alias("key"), F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), row).unionByName(first)
    moment = F.col("key").startswith("t:")
    hits = cited.join(known, ["source_id", "key"]).where(~moment | ((F.col("start_ms") <= F.col("to")) & (F.col("end_ms") >= F.col("from"))))
    far = F.when(moment, F.abs(F.col("start_ms") - F.col("from"))).otherwise(0)
    best = hits.groupBy("citation_id").agg(F.min(F.struct(far.alias("far"), "u.pos", "u.unit_id")).getField("unit_id").alias("unit_id"))
    return citations.select("citation_id").distinct().join(best, "citation_id", "left")
