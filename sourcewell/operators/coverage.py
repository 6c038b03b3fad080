"""Coverage of a plan, gaps, budgets and the decision to go on, over many runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import text as t
from .collect import blank, channels


def coverage_summary(sources: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """One row a run: sources, comments, platforms, cited, with comments, with transcripts, provider runs."""
    out = sources.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("n_comments").cast("long").alias("comments"), F.count_distinct("platform").alias("platforms"),
        F.count_if(F.col("citation_count") > 0).alias("cited"), F.count_if(F.col("n_comments") > 0).alias("with_comments"), F.count_if(~blank("transcript")).alias("with_transcripts"),
    )
    if logs is None:
        return out
    runs = logs.groupBy("run_id").agg(F.count(F.lit(1)).alias("provider_runs"), F.count_if("ok").alias("runs_ok"), F.count_if(~F.col("ok")).alias("runs_failed"))
    return out.join(runs, "run_id", "left").fillna(0, ["provider_runs", "runs_ok", "runs_failed"])


def run_confidence(coverage: DataFrame) -> DataFrame:
    """coverage (with runs_ok) plus score and confidence: high from 95, medium from 55, low from 20."""
    score = F.col("sources") * 8 + F.col("platforms") * 12 + F.least(F.lit(30), F.col("comments")) + F.col("with_transcripts") * 8 + F.col("runs_ok") * 4
    label = F.when(F.col("score") >= 95, "high").when(F.col("score") >= 55, "medium").when(F.col("score") >= 20, "low").otherwise("insufficient")
    return coverage.withColumn("score", score).withColumn("confidence", label)


def modalities() -> Column:
    """Kinds of evidence of a source: its channels, and text, speech and comment by what it has."""
    more = F.array_compact(F.array(F.when(~blank("title") | ~blank("summary"), "text"), F.when(~blank("transcript"), "speech"), F.when(F.col("n_comments") > 0, "comment")))
    return F.array_distinct(F.concat(channels(), more))


def gate_text() -> Column:
    """What entities and counter-evidence are sought in."""
    return F.lower(F.concat_ws(" ", *(F.nullif(t.strip(F.coalesce(t.c(x), F.lit(""))), F.lit("")) for x in ("title", "summary", "transcript", "comment_text"))))


def coverage_gate(sources: DataFrame, plans: DataFrame, counter_words: tuple[str, ...] = k.COUNTER_WORDS) -> DataFrame:
    """One row a run of plans (run_id, platforms, entities, intents: arrays): what is covered and what is missing.

    Entities are sought as lower-cased parts of the text. Missing ones keep the plan's order.
    """
    text = sources.withColumn("gate_text", gate_text())
    entity = plans.select("run_id", F.explode("entities").alias("entity")).where(F.trim("entity") != "").distinct()
    seen = text.select("run_id", "gate_text").join(entity, "run_id").where(F.contains(F.col("gate_text"), F.lower(F.trim("entity")))).groupBy("run_id").agg(F.collect_set("entity").alias("entities_covered"))
    found = text.groupBy("run_id").agg(
        F.sort_array(F.collect_set("platform")).alias("platforms_covered"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(modalities())))).alias("modalities"),
        F.count_if(t.has_any("gate_text", counter_words)).alias("counter_sources"),
        F.count(F.lit(1)).alias("n_sources"),
    )
    none = F.array().cast("array<string>")
    rows = plans.join(found, "run_id", "left").join(seen, "run_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("platforms_covered", "modalities", "entities_covered")}).fillna(0, ["counter_sources", "n_sources"])
    return (
        rows.withColumn("missing_platforms", F.array_except("platforms", "platforms_covered"))
        .withColumn("missing_entities", F.array_except("entities", "entities_covered"))
        .withColumn("entities_covered", F.array_intersect("entities", "entities_covered"))
        .withColumn("counter_found", F.col("counter_sources") > 0)
        .withColumn("sufficient", (F.size("missing_platforms") == 0) & (F.size("missing_entities") == 0))
    )


def block_synthesis(gate: DataFrame, exhausted: Column, min_platforms: int = k.MIN_PLATFORMS) -> DataFrame:
    """gate plus blocked: a severe gap is left and the budget (exhausted: boolean) lets the search go on."""
    severe = (F.size("platforms_covered") < min_platforms) | ((F.size("missing_entities") > 0) & (F.size("entities_covered") == 0)) | (F.size("modalities") == 0)
    return gate.withColumn("blocked", ~exhausted & severe)


def coverage_gaps(gate: DataFrame) -> DataFrame:
    """run_id and gaps: platforms, entities, intents without a fitting modality, counter-evidence."""
    expected = F.create_map(*(x for name, kinds in k.INTENT_MODALITIES.items() for x in (F.lit(name), t.words(kinds))))
    unmet = F.filter("intents", lambda i: ~F.arrays_overlap(F.coalesce(F.try_element_at(expected, i), F.array(i)), F.col("modalities")))
    tag = lambda name, x: F.transform(x, lambda v: F.concat(F.lit(f"{name}:"), v))
    counter = F.when(~F.col("counter_found"), F.array(F.lit("counterevidence"))).otherwise(F.array().cast("array<string>"))
    return gate.select("run_id", F.concat(tag("platform", "missing_platforms"), tag("entity", "missing_entities"), tag("evidence_intent", unmet), counter).alias("gaps"))


def budget_remaining(used: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """used (a column for each limit) plus remaining: the least of the shares left, from 0 to 1, to four places."""
    limits = limits or k.BUDGET
    shares = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(v) - F.col(name)) / F.lit(float(v)))) if v > 0 else F.lit(0.0) for name, v in limits.items()]
    return used.withColumn("remaining", F.round(F.least(*shares), 4))


def stop_policy(sources: DataFrame, logs: DataFrame, max_sources: int = k.BUDGET["sources"]) -> DataFrame:
    """run_id, keep_searching, stop_insufficient from sources (label) and logs (ok, count) of each run."""
    s = sources.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("platform").alias("platforms"), F.count_if(F.col("label").isin("Strong", "Moderate")).alias("good"), F.count_if(F.col("label") != "Insufficient").alias("usable")
    )
    ok = logs.groupBy("run_id").agg(F.count_if(F.col("ok") & (F.col("count") > 0)).alias("ok_runs"))
    rows = s.join(ok, "run_id", "full").fillna(0)
    keep = F.when(F.col("n") >= max_sources, False).otherwise((F.col("n") < k.MIN_SOURCES) | (F.col("platforms") < k.MIN_PLATFORMS) | (F.col("good") < min(2, k.MIN_SOURCES)))
    return rows.select("run_id", "n", keep.alias("keep_searching"), ((F.col("n") == 0) | ((F.col("usable") == 0) & (F.col("ok_runs") == 0))).alias("stop_insufficient"))


def platform_retry(planned: DataFrame, logs: DataFrame) -> DataFrame:
    """planned (run_id, platform) plus retry: never run, or run once without success and without a lasting failure."""
    seen = logs.groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("ok") & (F.col("count") > 0)).alias("good"), F.max_by("note", "seq").alias("note"))
    rows = planned.join(seen, ["run_id", "platform"], "left").fillna(0, ["runs", "good"])
    lasting = t.has_any("note", ("unsupported", "permission denied", "invalid query"))
    return rows.select("run_id", "platform", "runs", F.when(F.col("runs") == 0, True).when((F.col("runs") >= 2) | (F.col("good") > 0), False).otherwise(~lasting).alias("retry"))


def fallback_rows(primary: DataFrame, fallback: DataFrame, limit: int) -> DataFrame:
    """Rows of fallback (run_id, platform) for platforms with fewer primary rows than min(limit, max(3, limit / 2))."""
    enough = primary.groupBy("run_id", "platform").count().where(F.col("count") >= min(limit, max(3, limit // 2)))
    return fallback.join(enough, ["run_id", "platform"], "left_anti")


def retry_targets(gate: DataFrame, limit: int, max_sources: int = k.BUDGET["sources"]) -> DataFrame:
    """run_id, platform, limit: planned platforms that are missing, limited to the slots left."""
    room = F.greatest(F.lit(0), F.lit(max_sources) - F.col("n_sources"))
    return gate.select("run_id", F.explode("missing_platforms").alias("platform"), F.least(F.lit(limit), room).alias("limit")).where("limit > 0")
