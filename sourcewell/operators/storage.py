"""Keyed tables without MERGE: upserts as new snapshots, field overlays, integrity-checked generations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where a local master leaves it unset, a new one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_sourcewell_tables", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark._sourcewell_tables = tempfile.mkdtemp(prefix="spark-")
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what several steps use is made once, and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_snapshot(base: DataFrame, delta: DataFrame, keys: list[str], modified: str = "last_modify_ts", added: str = "add_ts") -> DataFrame:
    """base after writing delta's rows over it by key: the row modified last wins (delta's among equals), its add time
    is the earliest of the key and its modification time the latest. A key that occurs once stays as it is."""
    rows = base.withColumn("__new", F.lit(0)).unionByName(delta.withColumn("__new", F.lit(1)))
    value = F.struct(*(c for c in base.columns if c not in keys))
    agg = rows.groupBy(*keys).agg(F.max_by(value, F.struct(modified, "__new")).alias("v"), F.min(added).alias("__added"), F.max(modified).alias("__modified"))
    out = {added: F.col("__added"), modified: F.col("__modified")}
    return agg.select(*(F.col(c) if c in keys else out.get(c, F.col(f"v.`{c}`")).alias(c) for c in base.columns))


def upsert_fields(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base after setting delta's fields by key; fields that are null in delta keep their value. Keys occur once in
    either table; columns of delta alone are added."""
    columns = [c for c in dict.fromkeys([*base.columns, *delta.columns]) if c not in keys]
    b = base.select(*keys, F.struct(*(c for c in base.columns if c not in keys)).alias("__b"))
    d = delta.select(*keys, F.struct(*(c for c in delta.columns if c not in keys)).alias("__d"))
    pick = lambda c: F.coalesce(*([F.col(f"__d.`{c}`")] if c in delta.columns else []), *([F.col(f"__b.`{c}`")] if c in base.columns else []))
    return b.join(d, keys, "full").select(*keys, *(pick(c).alias(c) for c in columns))


def write_deltas(delta: DataFrame, path: str, keys: list[str], epoch: int, buckets: int = 64) -> None:
    """Add a batch to a keyed table that is kept as deltas: its rows go to their keys' buckets, one folder an epoch.

    Nothing else is read or written, and an epoch that is written again replaces its own folders, so a repeated batch
    changes nothing. Folders have even numbers; odd ones are those that compact() has merged, which no batch replaces. The
    number of buckets must stay as it is.
    """
    rows = delta.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("epoch", F.lit(2 * epoch).cast("long"))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(path)


def _merged(rows: DataFrame, keys: list[str], modified: str, added: str, also: tuple[str, ...] = ()) -> DataFrame:
    columns = [c for c in rows.columns if c not in (*keys, *also, "epoch", "bucket")]
    # Of equal times the later epoch wins; in one epoch the greatest row, so that the result doesn't depend on order.
    value, order = F.struct(*columns), F.struct(modified, "epoch", F.to_json(F.struct(*columns)))
    agg = rows.groupBy(*also, *keys).agg(F.max_by(value, order).alias("v"), F.min(added).alias("__added"), F.max(modified).alias("__modified"))
    out = {added: F.col("__added"), modified: F.col("__modified")}
    return agg.select(*also, *keys, *(out.get(c, F.col(f"v.`{c}`")).alias(c) for c in columns))


def read_keyed(spark: SparkSession, path: str, keys: list[str], modified: str = "last_modify_ts", added: str = "add_ts") -> DataFrame:
    """The keyed table of all epochs, merged as it is read: the row modified last, with the key's earliest add time."""
    return _merged(spark.read.parquet(path), keys, modified, added)


def compact(spark: SparkSession, path: str, keys: list[str], most: int = 8, modified: str = "last_modify_ts", added: str = "add_ts") -> int:
    """Merge the epochs of each bucket that has more than `most`; returns the number of buckets merged.

    The merged rows are written next to the newest epoch before the others are removed. A reader or a failure in between
    meets rows twice, which merge to the same table; so does a batch that comes again. Other buckets aren't touched.
    """
    rows = spark.read.parquet(path)
    epochs = rows.select("bucket", "epoch").distinct().groupBy("bucket").agg(F.sort_array(F.collect_list("epoch")).alias("epochs")).where(F.size("epochs") > most)
    touched = {r.bucket: r.epochs for r in epochs.collect()}  # a row for each bucket at most
    if not touched:
        return 0
    newest = F.create_map(*(F.lit(x) for b, e in touched.items() for x in (b, e[-1] | 1)))
    merged = written(_merged(rows.where(F.col("bucket").isin(*touched)), keys, modified, added, ("bucket",)).withColumn("epoch", newest[F.col("bucket")]))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for bucket, old in touched.items():
        for epoch in set(old) - {old[-1] | 1}:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}/epoch={epoch}"), True)
    return len(touched)


def payload_rows(df: DataFrame, kind: str, schema_version: int = 1) -> DataFrame:
    """Snapshot rows of a table: schema version, kind, payload (JSON of each row) and its hash."""
    payload = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(F.lit(schema_version).alias("schemaVersion"), F.lit(kind).alias("kind"), payload.alias("payload"), F.sha2(payload, 256).alias("payloadHash"))


def check_snapshot(rows: DataFrame, kind: str, schema_version: int = 1) -> DataFrame:
    """The same rows; reading a row whose kind, version or hash differs raises an error."""
    good = (F.col("kind") == kind) & (F.col("schemaVersion") == schema_version) & (F.sha2("payload", 256) == F.col("payloadHash"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("snapshot row of kind "), F.coalesce("kind", F.lit("?")), F.lit(" fails its check"))))
    return rows.withColumn("payload", checked)


def write_generation(tables: dict[str, DataFrame], root: str) -> str:
    """Write tables as a new generation, then point to it; readers see the old one until the pointer is written."""
    generation = uuid.uuid4().hex
    for kind, df in tables.items():
        payload_rows(df, kind).write.parquet(f"{root}/generation={generation}/{kind}")
    spark = next(iter(tables.values())).sparkSession
    pointer = spark.range(1).select(F.lit(generation).alias("generation"), F.current_timestamp().alias("writtenAt"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return generation


def read_generation(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    """The newest generation's table of a kind, checked row by row."""
    newest = spark.read.parquet(f"{root}/pointer").agg(F.max_by("generation", "writtenAt")).first()[0]
    rows = check_snapshot(spark.read.parquet(f"{root}/generation={newest}/{kind}"), kind)
    return rows.select(F.from_json("payload", schema).alias("v")).select("v.*")


def sequence_events(events: DataFrame, order: list[str]) -> DataFrame:
    """events with sequence, from 1 for each run, and progress_max, the highest progress so far; a run may be of any size."""
    from .ordered import numbered

    return numbered(events, ["run_id"], order, "sequence", {"progress_max": "progress"})


def replay(events: DataFrame, after: int) -> DataFrame:
    """Events of a run after a sequence number."""
    return events.where(F.col("sequence") > after)
