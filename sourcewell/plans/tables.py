"""Queries over keyed tables and run logs: upserts, snapshots, caps, edges, event folds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.times import in_days
from ..operators import collect, storage
from ..streaming import handover, reuse, runs
from . import views as v

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _base_delta(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"), (F.col("o_orderkey") * 10).alias("add_ts"), (F.col("o_orderkey") * 10).alias("last_modify_ts"))
    delta = o.where("id % 3 = 0").select("id", F.lit("X").alias("status"), (F.col("price") + 1).alias("price"), (F.col("add_ts") + 5).alias("add_ts"), (F.col("add_ts") + 5).alias("last_modify_ts"))
    return o.where("id % 2 = 0"), delta


@query(
    """with o as (select o_orderkey as id, o_orderstatus as status, round(o_totalprice, 2) as price, o_orderkey * 10 as ts from orders)
select id, case when id % 3 = 0 then 'X' else status end as status, cast(round((case when id % 3 = 0 then price + 1 else price end) * 100, 0) as bigint) as cents, case when id % 2 = 0 then ts else ts + 5 end as add_ts, case when id % 3 = 0 then ts + 5 else ts end as last_modify_ts from o where id % 2 = 0 or id % 3 = 0"""
)
def upsert_snapshot(spark, sf):
    rows = storage.upsert_snapshot(*_base_delta(spark, sf), ["id"])
    return rows.select("id", "status", F.round(F.col("price") * 100, 0).cast("long").alias("cents"), "add_ts", "last_modify_ts")


@query(
    """with o as (select o_orderkey as id, o_orderstatus as status, o_orderkey * 10 as ts from orders)
select id, case when id % 2 = 0 then status when id % 3 = 0 then 'D' end as status, case when id % 3 = 0 then 'seen' end as note, case when id % 2 = 0 then ts end as ts from o where id % 2 = 0 or id % 3 = 0"""
)
def upsert_merge_fields(spark, sf):
    base, delta = _base_delta(spark, sf)
    fields = delta.select("id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit("D")).alias("status"), F.lit("seen").alias("note"))
    return storage.upsert_fields(base.select("id", "status", F.col("add_ts").alias("ts")), fields, ["id"]).select("id", "status", "note", "ts")


@query("""with p as (select item_id, '{"item_id":' || item_id || ',"kind_of":"bench"}' as payload from benchmark) select 1 as "schemaVersion", 'items' as kind, payload, sha256(payload) as "payloadHash" from p""")
def snapshot_verify(spark, sf):
    return storage.check_snapshot(storage.payload_rows(v.table(spark, sf, "benchmark").select("item_id", F.lit("bench").alias("kind_of")), "items"), "items")


@query(
    """with p as (select o_orderpriority as keyword, cast(o_orderdate as date) as day, o_orderkey as post_id from orders), d as (select *, row_number() over (partition by keyword, day order by post_id) as of_day from p qualify of_day <= 2)
select keyword, post_id, of_day, row_number() over (partition by keyword order by day, of_day) as of_all from d qualify of_all <= 500"""
)
def daily_cap(spark, sf):
    return collect.daily_cap(v.post(spark, sf), 2, 500).select("keyword", "post_id", "of_day", "of_all")


@query("select distinct l_suppkey as up_id, l_partkey as fan_id from lineitem where l_linenumber % 2 = 1 union select distinct l_partkey, l_suppkey from lineitem where l_linenumber % 2 = 0")
def contact_edges(spark, sf):
    line = v.table(spark, sf, "lineitem")
    one = line.where("l_linenumber % 2 = 1").select(F.col("l_suppkey").alias("creator_id"), F.col("l_partkey").alias("contact_id"))
    two = line.where("l_linenumber % 2 = 0").select(F.col("l_suppkey").alias("creator_id"), F.col("l_partkey").alias("contact_id"))
    return collect.contact_edges(one, two)


@query("select o_orderpriority as keyword, count(*) as n from orders where o_orderdate >= timestamp '1995-03-01' and o_orderdate <= timestamp '1996-03-31 23:59:59' group by 1")
def date_range(spark, sf):
    return v.post(spark, sf).where(in_days("o_orderdate", "1995-03-01", "1996-03-31")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def _log(spark, sf):
    return storage.sequence_events(v.runlog(spark, sf), ["ts", "event_id"])


@query(f"with {v.RUNLOG} select run_id, event_id, sequence from runlog")
def event_sequence(spark, sf):
    return _log(spark, sf).select("run_id", "event_id", F.col("sequence").cast("long").alias("sequence"))


@query(f"with {v.RUNLOG} select run_id, event_id, max(progress) over (partition by run_id order by sequence rows unbounded preceding) as progress_max from runlog")
def running_progress(spark, sf):
    return _log(spark, sf).select("run_id", "event_id", "progress_max")


@query(
    f"""with {v.RUNLOG} select run_id, coalesce(arg_max(case type when 'error' then 'failed' when 'final_report' then 'completed' else 'running' end, sequence) filter (where type in ('error', 'final_report', 'run_started')), 'queued') as status, max(progress) as progress, count(*) as event_count,
  min(ts) filter (where type = 'run_started') as started_at, max(ts) filter (where type in ('final_report', 'error')) as completed_at from runlog group by 1"""
)
def run_state_fold(spark, sf):
    return runs.run_state(_log(spark, sf))


@query(
    f"""with {v.RUNLOG}, e as (select run_id, min(sequence) filter (where type in ('final_report', 'error')) as fin from runlog group by 1)
select run_id, event_id, type, cast(sequence as bigint) as sequence from runlog join e using (run_id) where sequence <= greatest(3, coalesce(fin, sequence))"""
)
def live_replay(spark, sf):
    """The first three events of each run stored, the others as a log that grows while it is followed: it begins before the
    stored ones end, is out of order and repeats events, also after a restart."""
    root = f"{storage.shared_dir(spark)}/live-{uuid.uuid4().hex}"
    log = storage.written(_log(spark, sf).select("run_id", "event_id", "type", F.col("sequence").cast("long").alias("sequence")))
    stored = log.where("sequence <= 3")
    first = F.col("sequence") + F.pmod("event_id", F.lit(8)) < 12
    late = log.where(~first).unionByName(log.where("sequence % 5 = 0"))
    for part in (log.where(first & F.expr("sequence >= 2")), late):
        part.repartition("event_id").write.mode("append").json(f"{root}/log")
        live = spark.readStream.schema(log.schema).json(f"{root}/log")
        with handover.settings(spark, handover.DRAINED):
            followed = handover.follow(live, stored).writeStream.option("checkpointLocation", f"{root}/checkpoint")
            followed.trigger(availableNow=True).start(f"{root}/followed", format="parquet").awaitTermination()
    return stored.unionByName(spark.read.schema(log.schema).parquet(f"{root}/followed"))


@query("select sha256(coalesce(text, '')) as content_hash, count(*) as media, 1 as transcribed, count(*) - 1 as reused from documents group by 1")
def reuse_stream(spark, sf):
    """Whole documents as media that arrive in three batches: of each content one is transcribed, whatever batch it is in."""
    root = f"{storage.shared_dir(spark)}/reuse-{uuid.uuid4().hex}"
    media = v.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    hashed = storage.written(media)
    for part in range(3):
        hashed.where(F.pmod("doc_id", F.lit(3)) == part).write.mode("append").parquet(f"{root}/media")
        live = spark.readStream.schema(hashed.schema).parquet(f"{root}/media")
        reuse.reuse(live, f"{root}/index", f"{root}/out", f"{root}/checkpoint", ["doc_id"]).awaitTermination()
    told = spark.read.schema("doc_id long, content_hash string, reused boolean").parquet(f"{root}/out")
    return told.groupBy("content_hash").agg(F.count(F.lit(1)).alias("media"), F.count_if(~F.col("reused")).cast("int").alias("transcribed"), F.count_if("reused").alias("reused"))


@query(f"with {v.RUNLOG} select run_id, type as stage, arg_max(progress, sequence) as progress, arg_max(message, sequence) as message from runlog group by 1, 2")
def stage_progress(spark, sf):
    return runs.stage_progress(_log(spark, sf))


@query(f"with {v.RUNLOG}, s as (select run_id, type, arg_max(progress, sequence) as progress from runlog group by 1, 2) select run_id, cast(least(100, round_even(avg(progress), 0)) as integer) as progress from s group by 1")
def overall_progress(spark, sf):
    return runs.overall_progress(runs.stage_progress(_log(spark, sf)))


@query(f"with {v.LOGS} select run_id, platform, case when seq % 2 = 0 then 'crawler' else 'cli' end as provider, arg_max(case when ok then 'ok' else 'failed' end, seq) as status, arg_max(note, seq) as message from logs group by 1, 2, 3")
def provider_activity(spark, sf):
    rows = v.logs(spark, sf).select("run_id", "platform", F.when(F.col("seq") % 2 == 0, "crawler").otherwise("cli").alias("provider"), F.when(F.col("ok"), "ok").otherwise("failed").alias("status"), F.col("note").alias("message"), F.col("seq").alias("sequence"))
    return runs.provider_activity(rows)


@query(
    f"""with {v.RUNLOG}, r as (select run_id, bool_or(type in ('final_report', 'error')) as ended, epoch(min(ts) filter (where type = 'sources')) - epoch(min(ts)) as wait from runlog group by 1),
found as (select conv_id % 50 as run_id, count(*) >= 60 as enough from conversations group by 1)
select count(*) as runs, round(avg(cast(ended as integer)), 6) as ended_share, round(avg(wait), 3) as mean_wait, (select round(avg(cast(enough as integer)), 6) from found) as citable_share,
  (select round(avg(cast(l.doc_id is not null as integer)), 6) from documents d left join labels l on l.doc_id = d.doc_id) as resolved_share from r"""
)
def exit_metrics(spark, sf):
    """Conversations as sources of fifty runs; documents as citations of those that have labels."""
    sources = v.table(spark, sf, "conversations").select((F.col("conv_id") % 50).alias("run_id"))
    labels = v.table(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("unit_id"))
    return runs.exit_metrics(_log(spark, sf), sources, v.table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left"), 60)


@query(
    """with d as (select o_custkey as id, o_orderkey as note, o_orderdate as ts, o_orderkey % 3 as epoch from orders)
select id, arg_max(note, (ts, epoch, note)) as note, min(ts) as add_ts, max(ts) as last_modify_ts from d group by 1"""
)
def keyed_deltas(spark, sf):
    """Orders as three batches of changes to customers, one of them written twice, merged in part and read by key."""
    path = f"{storage.shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    # Notes of one length, so that the greatest row of an epoch is the one with the greatest number.
    rows = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("note"), F.col("o_orderdate").alias("add_ts"), F.col("o_orderdate").alias("last_modify_ts"), (F.col("o_orderkey") % 3).alias("batch"))
    for epoch in (0, 1, 1, 2):
        storage.write_deltas(rows.where(F.col("batch") == epoch).drop("batch"), path, ["id"], epoch, 16)
        if epoch == 1:
            storage.compact(spark, path, ["id"], most=1)
    return storage.read_keyed(spark, path, ["id"]).withColumn("note", F.col("note").cast("bigint"))


@query(f"with {v.RUNLOG}, s as (select run_id, type as section_id, sequence, sequence % 7 = 0 as complete, message as text from runlog), f as (select *, max(case when complete then sequence end) over (partition by run_id, section_id) as fr from s) select run_id, section_id, string_agg(text, '' order by sequence) as text from f where sequence >= coalesce(fr, 0) group by 1, 2")
def section_assembly(spark, sf):
    rows = _log(spark, sf).select("run_id", F.col("type").alias("section_id"), "sequence", (F.col("sequence") % 7 == 0).alias("complete"), F.col("message").alias("text"))
    return runs.sections(rows)
