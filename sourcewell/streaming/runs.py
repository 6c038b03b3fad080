"""Run logs: states, stages, activity, sections and windows, for tables and streams alike.

Events have run_id, sequence, type, progress, message, payload and ts. Each fold is an aggregation by order of the
writer's sequence, so arrival order doesn't matter and the batch result equals the stream's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "run_id string, sequence long, type string, progress int, message string, payload string, ts timestamp"

# fixed values: what an event says of its run's status
TERMINAL = ("completed", "partial", "failed", "cancelled")


def tail(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """The event log as a stream of JSON lines."""
    return spark.readStream.schema(schema).json(path)


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, though a hand-over may bring it twice, within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "sequence"])


def _status(kind, payload):
    return (
        F.when(kind == "error", "failed")
        .when(kind == "final_report", F.coalesce(F.nullif(F.get_json_object(payload, "$.status"), F.lit("")), F.lit("completed")))
        .when(kind == "run_cancelled", "cancelled")
        .when(kind == "run_started", "running")
    )


def run_state(events: DataFrame) -> DataFrame:
    """run_id, status, progress, event_count, started_at, completed_at: the last event that tells a status wins, and
    progress never falls. Streams use the update or complete mode; state is one row a run."""
    status = _status(F.col("type"), F.col("payload"))
    return events.groupBy("run_id").agg(
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), F.col("sequence"))), F.lit("queued")).alias("status"),
        F.max("progress").alias("progress"),
        F.count(F.lit(1)).alias("event_count"),
        F.min(F.when(F.col("type") == "run_started", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("type").isin("final_report", "error", "run_cancelled"), F.col("ts"))).alias("completed_at"),
    )


def cancel_stale(states: DataFrame) -> DataFrame:
    """States after a restart: runs that haven't ended are cancelled."""
    return states.withColumn("status", F.when(F.col("status").isin(*TERMINAL), F.col("status")).otherwise("cancelled"))


def stage_progress(events: DataFrame) -> DataFrame:
    """run_id, stage (the event's type), progress and message of its latest event."""
    return events.groupBy("run_id", F.col("type").alias("stage")).agg(F.max_by("progress", "sequence").alias("progress"), F.max_by("message", "sequence").alias("message"))


def overall_progress(stages: DataFrame) -> DataFrame:
    """run_id, progress: the mean of its stages, to the even whole, at most 100."""
    return stages.groupBy("run_id").agg(F.least(F.lit(100), F.bround(F.avg("progress"), 0).cast("int")).alias("progress"))


def provider_activity(events: DataFrame) -> DataFrame:
    """run_id, platform, provider with the latest status and message of each pair."""
    return events.groupBy("run_id", "platform", "provider").agg(F.max_by("status", "sequence").alias("status"), F.max_by("message", "sequence").alias("message"))


def platform_counts(sources: DataFrame) -> DataFrame:
    """Sources so far of each run and platform."""
    return sources.groupBy("run_id", "platform").count()


def new_sources(sources: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each dedupe_key of a run once within the delay."""
    return sources.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "dedupe_key"])


def sections(events: DataFrame) -> DataFrame:
    """run_id, section_id, text: deltas in sequence; a complete text replaces the deltas before it. Section events
    have section_id, sequence, complete and text."""
    last = F.max(F.when(F.col("complete"), F.col("sequence")))
    parts = F.sort_array(F.collect_list(F.struct("sequence", "text")))
    agg = events.groupBy("run_id", "section_id").agg(last.alias("__from"), parts.alias("__parts"))
    kept = F.filter("__parts", lambda p: p["sequence"] >= F.coalesce(F.col("__from"), F.lit(0)))
    return agg.select("run_id", "section_id", F.array_join(F.transform(kept, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"))


def event_windows(events: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events of each type in windows of event time; late ones within the delay count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def run_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each run: events no further apart than the gap."""
    return events.withWatermark("ts", delay).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def exit_metrics(events: DataFrame, sources: DataFrame | None = None, citations: DataFrame | None = None, citable: int = 3) -> DataFrame:
    """One row: runs, share that ended, mean seconds from the first event to the first sources; with sources (run_id) the
    share of their runs that have `citable` of them, and with citations (unit_id, null if unresolved) the resolved share."""
    runs = events.groupBy("run_id").agg(
        F.bool_or(F.col("type").isin("final_report", "error", "run_cancelled")).alias("ended"),
        (F.min(F.when(F.col("type") == "sources", F.col("ts"))).cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("wait"),
    )
    share = lambda x: F.round(F.avg(x.cast("int")), 6)
    out = runs.agg(F.count(F.lit(1)).alias("runs"), share(F.col("ended")).alias("ended_share"), F.round(F.avg("wait"), 3).alias("mean_wait"))
    # Each of these tables is one row.
    if sources is not None:
        out = out.join(sources.groupBy("run_id").agg((F.count(F.lit(1)) >= citable).alias("enough")).agg(share(F.col("enough")).alias("citable_share")))
    if citations is not None:
        out = out.join(citations.agg(share(F.col("unit_id").isNotNull()).alias("resolved_share")))
    return out


def upsert_stream(deltas: DataFrame, read_base: Callable[[SparkSession], DataFrame], write: Callable[[DataFrame], None], keys: list[str], checkpoint: str):
    """Write each micro-batch of deltas over a keyed table: read_base gives the newest, write stores the next."""
    from ..operators.storage import upsert_snapshot

    def one(batch: DataFrame, epoch: int) -> None:
        write(upsert_snapshot(read_base(batch.sparkSession), batch, keys))

    return deltas.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delta_stream(deltas: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 64):
    """Write each micro-batch as one epoch of a keyed table of deltas: work grows with the batch, not with the table, and a
    batch that comes again after a failure changes nothing. storage.read_keyed() reads it, storage.compact() tidies up."""
    from ..operators.storage import write_deltas

    def one(batch: DataFrame, epoch: int) -> None:
        write_deltas(batch, path, keys, epoch, buckets)

    return deltas.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
