"""Queries of the smaller operators: text and time functions, captions, payloads, evidence, run logs, formats."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import text as t
from ..functions import times, urls
from ..operators import collect, coverage, evidence, grounding, normalize, report, responses, storage
from ..sources import io, relational
from ..streaming import runs
from . import research as r
from . import tables
from . import views as v

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SQUEEZED = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def _shared(spark, name: str) -> str:
    return f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- functions -------------------------------------------------------------------------------------------------------


@query(rf"with {v.SRC} select source_id, coalesce(nullif({_STRIP.format('creator')}, ''), nullif({_STRIP.format('title')}, ''), '') as told, regexp_extract(url, '([^/]*)$', 1) as trace, substr(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) as slug, cast(least(5, greatest(1, source_id % 9 - 1)) as integer) as clipped from src")
def text_functions(spark, sf):
    s = v.src(spark, sf)
    return s.select("source_id", t.first_nonempty("creator", "title").alias("told"), urls.trace_id("url").alias("trace"), t.slug("url").alias("slug"), t.clip((F.col("source_id") % 9 - 1).cast("string"), 1, 5).alias("clipped"))


@query(r"select page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) as text_sha256 from pages")
def html_text(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", F.sha2(t.html_text("html"), 256).alias("text_sha256"))


_COUNT = "case o_orderkey % 6 when 0 then (o_orderkey % 97) || '万' when 1 then (o_orderkey % 97) || '.5k likes' when 2 then 'none' when 3 then o_orderkey || '' when 4 then '2亿' end"


@query(f"with c as (select o_orderkey, o_orderkey % 6 as m, o_orderkey % 97 as n from orders) select o_orderkey, cast(case m when 0 then n * 10000 when 1 then n * 1000 + 500 when 3 then o_orderkey when 4 then 200000000 end as bigint) as n from c")
def first_numbers(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", t.first_number(F.expr(_COUNT)).alias("n"))


@query(
    """with e as (select o_orderkey, o_orderkey * 1000 as s, date '2020-01-01' + cast(o_orderkey % 900 as integer) as d from orders)
select o_orderkey, cast(epoch(make_timestamp((case when s > 1000000000000 then s // 1000 else s end) * 1000000)) as bigint) as at, cast(epoch(d) as bigint) as published, cast(epoch(d) as bigint) + 3600 as mailed, case when o_orderkey % 3 = 0 then 0 else cast(epoch(d) as bigint) end as told from e"""
)
def time_functions(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", F.expr("date_add(date'2020-01-01', cast(o_orderkey % 900 as int))").alias("d"))
    iso = F.date_format("d", "yyyy-MM-dd")
    mail = F.concat(F.date_format("d", "EEE MMM dd"), F.lit(" 02:00:00 +0100 "), F.date_format("d", "yyyy"))
    told = F.when(F.col("o_orderkey") % 3 == 0, "soon").otherwise(F.concat(iso, F.lit(" 00:00:00")))
    seconds = lambda x: x.cast("timestamp").cast("long")
    return o.select("o_orderkey", seconds(times.from_epoch((F.col("o_orderkey") * 1000).cast("string"))).alias("at"), seconds(times.published(F.concat(iso, F.lit("T00:00:00Z")))).alias("published"), seconds(times.from_rfc2822(mail)).alias("mailed"), times.to_epoch(told).alias("told"))


_ASKED = {"business": "market landscape of pets", "decision": "should i buy it", "comparison": "this vs that", "explainer": "why it rains", "general": "cats"}


@query(f"with b as (select item_id, item_id % 5 as m from benchmark) select item_id, [{', '.join(repr(x) for x in _ASKED)}][m + 1] as kind from b")
def report_kinds(spark, sf):
    asked = F.get(t.words(_ASKED.values()), (F.col("item_id") % 5).cast("int"))
    return v.table(spark, sf, "benchmark").select("item_id", t.report_kind(asked).alias("kind"))


# ---- payloads and captions -------------------------------------------------------------------------------------------


@query(r"with c as (select conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as x from conversations) select conv_id, turn * 1000 as start_ms, turn * 1000 + 500 as end_ms, x as text from c where x <> ''")
def json3_captions(spark, sf):
    seg = F.array(F.struct(F.col("text").alias("utf8")))
    one = F.struct((F.col("turn") * 1000).alias("tStartMs"), F.lit(500).alias("dDurationMs"), seg.alias("segs"))
    files = v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(one).alias("events"))).alias("content"))
    return io.json3_captions(files).select("conv_id", "start_ms", "end_ms", "text")


@query("with c as (select conv_id, turn, ['en', 'de', 'fr'][turn % 3 + 1] as lang, case when turn % 2 = 0 then 'json3' else 'vtt' end as ext from conversations) select conv_id as source_id, lang, ext from c qualify row_number() over (partition by conv_id order by case lang when 'de' then 0 when 'en' then 10 else 20 end + case ext when 'json3' then 0 else 1 end, lang, ext) = 1")
def pick_track(spark, sf):
    tracks = v.table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.get(t.words(("en", "de", "fr")), (F.col("turn") % 3).cast("int")).alias("lang"), F.when(F.col("turn") % 2 == 0, "json3").otherwise("vtt").alias("ext"))
    return io.pick_track(tracks, ["de", "en"])


@query("select conv_id, cast(turn as varchar) as turn, role from conversations")
def unwrap_payloads(spark, sf):
    """Rows under one of the usual names, nested once in every second payload."""
    item = F.struct("turn", "role")
    packed = v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("rows"))
    flat, deep = F.to_json(F.struct(F.col("rows").alias("items"))), F.to_json(F.struct(F.struct(F.col("rows").alias("list")).alias("data")))
    rows = io.unwrap(packed.select("conv_id", F.when(F.col("conv_id") % 2 == 0, flat).otherwise(deep).alias("payload")))
    return rows.select("conv_id", F.get_json_object("item", "$.turn").alias("turn"), F.get_json_object("item", "$.role").alias("role"))


@query(f"with {v.SRC} select source_id, case when source_id % 3 = 0 then null else cast(source_id as varchar) end as n from src")
def first_json(spark, sf):
    body = F.to_json(F.struct("source_id", "title"))
    text = F.when(F.col("source_id") % 3 == 0, "no [json {here").otherwise(F.concat(F.lit("log [x { "), body, F.lit(" end }")))
    found = io.first_json(v.src(spark, sf).select("source_id", text.alias("text")))
    return found.select("source_id", F.get_json_object("first_json", "$.source_id").alias("n"))


@query(f"with {v.SRC} select source_id, coalesce(title, '') as told, cast(source_id as varchar) as n from src")
def response_texts(spark, sf):
    """Texts of responses in three forms, and the JSON object inside a text."""
    title = F.coalesce("title", F.lit(""))
    form = F.col("source_id") % 3
    content = F.when(form == 0, F.to_json(F.array(F.struct(title.alias("text"))))).when(form == 1, F.to_json(F.struct(title.alias("text")))).otherwise(title)
    said = F.concat(F.lit("Sure: "), F.to_json(F.array(F.struct("source_id"))), F.lit(" done"))
    rows = v.src(spark, sf).select("source_id", content.alias("content"), said.alias("said"))
    return rows.select("source_id", responses.response_text().alias("told"), F.get_json_object(responses.response_json("said"), "$.items[0].source_id").alias("n"))


@query(f"with {v.SRC} select source_id, case source_id % 3 when 0 then source_id || ',' || (source_id + 2) when 1 then cast(source_id + 1 as varchar) else '' end as ids from src")
def valid_ids(spark, sf):
    i = F.col("source_id")
    listed = F.to_json(F.array(i, i + 2, i, i + 9))
    value = F.when(i % 3 == 0, listed).when(i % 3 == 1, F.to_json(F.struct((i + 1).alias("sourceId")))).otherwise("oops")
    ids = responses.valid_ids(value, F.array(i, i + 1, i + 2))
    return v.src(spark, sf).select("source_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


# ---- evidence --------------------------------------------------------------------------------------------------------


@query(f"with {r._QUALITY} select run_id, label, count(*) as n, count(*) filter (where n_comments > 0) as with_comments, count(*) filter (where coalesce(transcript, '') <> '') as with_transcripts from assessed group by 1, 2")
def label_counts(spark, sf):
    return evidence.label_counts(r.assessed(spark, sf))


@query(
    rf"""with {v.SRC}, c as (select conv_id, turn, {_SQUEEZED.format('text')} as x from conversations), j as (select conv_id, string_agg(x, ' ' order by turn) as x from c where x <> '' group by 1)
select source_id, sha256(coalesce(x, '')) as text_sha256, coalesce(substr(x, 1, 420), '') as preview from src left join j on conv_id = source_id"""
)
def attach_transcript(spark, sf):
    rows = evidence.attach_transcript(v.src(spark, sf), v.segments(spark, sf))
    return rows.select("source_id", F.sha2(F.coalesce("transcript", F.lit("")), 256).alias("text_sha256"), F.coalesce("transcript_preview", F.lit("")).alias("preview"))


_FIRST3 = "c as (select conv_id, list(text order by turn) as texts from (select *, row_number() over (partition by conv_id order by turn) as nth from conversations where role = 'user') where nth <= 3 group by 1)"


@query(
    f"""with {v.SRC}, {_FIRST3}, u as (select source_id, case when coalesce(transcript, '') <> '' then 'speech' else 'text' end as modality, substr(array_to_string(list_filter(list_concat([transcript, summary, title], coalesce(texts, [])), lambda x: coalesce(x, '') <> ''), chr(10)), 1, 1600) as x from src left join c on conv_id = source_id)
select source_id, modality, sha256(x) as text_sha256 from u where x <> ''"""
)
def evidence_units(spark, sf):
    rows = collect.with_comments(v.src(spark, sf), v.comments(spark, sf))
    return evidence.evidence_units(rows).select("source_id", "modality", F.sha2("text", 256).alias("text_sha256"))


@query(f"with {v.SRC}, {_FIRST3} select source_id, coalesce(substr(nullif(texts[1], ''), 1, 160), substr(nullif(transcript, ''), 1, 160), title || ' is a top-ranked source in this run; open it to verify context.') as quote from src left join c on conv_id = source_id")
def quotes(spark, sf):
    return report.quotes(collect.with_comments(v.src(spark, sf), v.comments(spark, sf)))


@query(f"with {r._QUALITY}, rk as (select run_id, source_id, url, row_number() over (partition by run_id order by case label when 'Strong' then 4 when 'Moderate' then 3 when 'Weak' then 2 else 1 end desc, relevance desc, (coalesce(transcript, '') <> '') desc, source_id) as display_id from assessed) select run_id, source_id from rk where display_id <= 3 and coalesce(url, '') <> ''")
def asr_candidates(spark, sf):
    return evidence.asr_candidates(collect.rank_evidence(r.assessed(spark, sf)), 3).select("run_id", "source_id")


@query("with d as (select doc_id, sha256(coalesce(text, '')) as h from documents) select doc_id from d where h not in (select h from d where doc_id % 3 = 0)")
def reusable_transcripts(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return evidence.reusable_transcripts(d, d.where("doc_id % 3 = 0")).select("doc_id")


_LINKS = "l as (select item_id as claim_id, item_id * 3 as unit_id from benchmark where item_id % 2 = 0), o as (select item_id as claim_id, unnest([item_id, item_id + 1, item_id + 1000000]) as unit_id from benchmark), ok as (select l.* from l join documents on doc_id = unit_id), lu as (select claim_id, unit_id from ok union select o.claim_id, o.unit_id from o join documents on doc_id = unit_id where o.claim_id not in (select claim_id from ok))"


def _linked(spark, sf):
    i = F.col("item_id")
    b = v.table(spark, sf, "benchmark")
    claims = b.select(i.alias("claim_id"), F.col("text").alias("claim_text"), F.array(i, i + 1, i + 1_000_000).alias("unit_ids"))
    links = b.where("item_id % 2 = 0").select(i.alias("claim_id"), (i * 3).alias("unit_id"), F.lit("insufficient").alias("relation"))
    return claims, links, v.table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id"), "text")


@query(f"with {_LINKS} select claim_id, unit_id from lu")
def linked_units(spark, sf):
    claims, links, units = _linked(spark, sf)
    return grounding.linked_units(claims, links, units)


@query(
    f"""with {_LINKS}, p as (select lu.claim_id, unit_id, {r._TERMS.format('b.text')} as ct, {r._TERMS.format("coalesce(d.text, '')")} as ut, {r._NEG.replace('{0}', 'b.text')} = {r._NEG.replace('{0}', "coalesce(d.text, '')")} as agrees from lu join benchmark b on b.item_id = claim_id join documents d on d.doc_id = unit_id),
s as (select claim_id, unit_id, len(list_intersect(ct, ut)) / cast(greatest(1, len(ct)) as double) as overlap, agrees from p),
g as (select item_id as claim_id, count(unit_id) filter (where overlap >= 0.3 and agrees) as s, count(unit_id) filter (where overlap >= 0.3 and not agrees) as x, coalesce(max(overlap), 0) as m from benchmark left join s on claim_id = item_id group by 1)
select claim_id, case when x > 0 then 'contradict' when s > 0 then 'support' else 'insufficient' end as relation, s as n_support, x as n_contradict, round(case when s > 0 and x > 0 then least(0.9, 0.55 + 0.08 * (s + x)) when x > 0 then least(0.95, 0.62 + 0.08 * x + 0.15 * m) when s > 0 then least(0.95, 0.58 + 0.08 * s + 0.2 * m) else greatest(0.05, least(0.45, m)) end, 3) as confidence from g"""
)
def verify_claims(spark, sf):
    claims, links, units = _linked(spark, sf)
    return grounding.verify(claims, units, links).select("claim_id", "relation", "n_support", "n_contradict", "confidence")


# ---- collection and coverage -----------------------------------------------------------------------------------------


@query(f"with {v.LOGS}, l as (select *, seq % 4 as p from logs), b as (select run_id, platform, min(p) as p from l group by 1, 2) select l.run_id, l.platform, seq from l join b on b.run_id = l.run_id and b.platform = l.platform and b.p = l.p")
def first_provider(spark, sf):
    rows = v.logs(spark, sf).withColumn("priority", F.col("seq") % 4)
    return collect.first_provider(rows, ["run_id", "platform"]).select("run_id", "platform", "seq")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) filter (where event_id % 3 = 0) as last_type, arg_max(event_id % 11, event_id) filter (where event_id % 4 = 1) as mark from events group by 1")
def overlay_sources(spark, sf):
    e = v.table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("last_type"), F.when(F.col("event_id") % 4 == 1, F.col("event_id") % 11).alias("mark"))
    return collect.overlay_sources(e, ["user_id"], "event_id")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) as pos_in_key from conversations qualify pos_in_key <= 2")
def capped(spark, sf):
    return collect.capped(v.table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 2)


@query(f"with {r._GATE}, n as (select run_id, count(*) as n from src group by 1), m as (select run_id, unnest(list_filter(['bilibili', 'youtube', 'tiktok'], lambda p: not list_contains(covered, p))) as platform from g) select run_id, platform, cast(least(12, greatest(0, 150 - n)) as bigint) as slots from m join n using (run_id) where least(12, greatest(0, 150 - n)) > 0")
def retry_targets(spark, sf):
    rows = coverage.retry_targets(r._gate(spark, sf), 12, 150)
    return rows.select("run_id", "platform", F.col("limit").cast("long").alias("slots"))


# ---- run logs --------------------------------------------------------------------------------------------------------


@query(f"with {v.RUNLOG} select time_bucket(interval 1 minute, ts) as start, type, count(*) as n from runlog group by 1, 2")
def event_windows(spark, sf):
    return runs.event_windows(v.runlog(spark, sf))


@query(
    f"""with {v.RUNLOG}, g as (select run_id, ts, case when lag(ts) over (partition by run_id order by ts) is null or ts - lag(ts) over (partition by run_id order by ts) >= interval 30 minutes then 1 else 0 end as fresh from runlog), s as (select *, sum(fresh) over (partition by run_id order by ts rows unbounded preceding) as no from g)
select run_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from s group by run_id, no"""
)
def run_sessions(spark, sf):
    return runs.run_sessions(v.runlog(spark, sf))


@query(f"with {v.SRC} select run_id, platform, count(*) as count from src group by 1, 2")
def platform_counts(spark, sf):
    return runs.platform_counts(v.src(spark, sf))


@query(f"with {v.RUNLOG}, s as (select run_id, coalesce(arg_max(case type when 'error' then 'failed' when 'final_report' then 'completed' else 'running' end, sequence) filter (where type in ('error', 'final_report', 'run_started')), 'queued') as status from runlog group by 1) select run_id, case when status in ('completed', 'failed') then status else 'cancelled' end as status from s")
def cancel_stale(spark, sf):
    return runs.cancel_stale(runs.run_state(tables._log(spark, sf))).select("run_id", "status")


@query(f"with {v.RUNLOG} select run_id, sequence, type from runlog where sequence > 3")
def replay(spark, sf):
    return storage.replay(tables._log(spark, sf), 3).select("run_id", F.col("sequence").cast("long").alias("sequence"), "type")


# ---- stored tables ---------------------------------------------------------------------------------------------------


@query("select item_id, text from benchmark where item_id % 2 = 1")
def snapshot_generation(spark, sf):
    """Two generations are written; the newer one is opened and checked row by row."""
    root = _shared(spark, "generations")
    b = v.table(spark, sf, "benchmark").select("item_id", "text")
    storage.write_generation({"items": b}, root)
    storage.write_generation({"items": b.where("item_id % 2 = 1")}, root)
    return storage.read_generation(spark, root, "items", "item_id long, text string")


@query("select kind, o_orderkey, o_orderpriority from orders, (select unnest(['jsonl', 'csv', 'parquet', 'orc']) as kind) where o_orderkey % 2 = 0")
def saved_formats(spark, sf):
    """A table written in each format, and found again by a value."""
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 2).alias("half"))
    schema = "o_orderkey long, o_orderpriority string, half long"
    out = []
    for kind in ("jsonl", "csv", "parquet", "orc"):
        path = _shared(spark, f"saved-{kind}")
        io.save(o, path, kind)
        reader = spark.read.schema(schema).option("header", True).format("json" if kind == "jsonl" else kind)
        out.append(io.find(reader.load(path), {"half": 0}).select(F.lit(kind).alias("kind"), "o_orderkey", "o_orderpriority"))
    return reduce(DataFrame.unionByName, out)


@query(
    """with b as (select c_custkey as id, c_name as name, c_mktsegment as segment, 2 as modified from customer
union all select c_custkey, c_name, 'moved', c_custkey % 3 + 1 from customer where c_custkey % 2 = 0
union all select c_custkey + 1000000000, c_name, 'added', c_custkey % 3 + 1 from customer where c_custkey % 5 = 0)
select id, name, arg_max(segment, modified * 10 + (segment = 'moved')::int) as segment, cast(max(modified) as integer) as modified from b group by id, name"""
)
def relational_store(spark, sf):
    """Customers in a database by key: all of them, then a batch of changed and added ones, of which a third is older, twice."""
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    age = (F.col("id") % 3 + 1).cast("int")
    changed = c.where("id % 2 = 0").withColumns({"segment": F.lit("moved"), "modified": age})
    added = c.where("id % 5 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "name", F.lit("added").alias("segment"), age.alias("modified"))
    database = _shared(spark, "store")
    relational.upsert(c.withColumn("modified", F.lit(2)), database, "customers", ["id"], "modified", "first")
    for _ in range(2):
        relational.upsert(changed.unionByName(added), database, "customers", ["id"], "modified", "second")
    return relational.read(spark, database, "customers", "id long, name string, segment string, modified int", "id")


@query("select o_orderkey, o_orderpriority, case when o_orderkey % 3 > 0 then o_comment end as note from (select *, '[' || o_orderpriority || ',]' as o_comment from orders)")
def json_array(spark, sf):
    """Orders as one JSON array in pieces, and read again; notes hold brackets and are missing in a third."""
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.expr("case when o_orderkey % 3 > 0 then '[' || o_orderpriority || ',]' end").alias("note"))
    path = _shared(spark, "array")
    io.save(o, path, "array", keys=("o_orderkey",))
    return io.read_array(spark, path, "o_orderkey long, o_orderpriority string, note string")


@query("select o_orderkey, o_orderkey % 4 as day from orders order by day desc, o_orderkey limit 500")
def crawl_newest(spark, sf):
    """The first 500 rows of orders as crawl files of four days, newest first."""
    o = v.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("day"))
    root = _shared(spark, "crawl")
    for day in range(4):
        o.where(F.col("day") == day).orderBy("o_orderkey").write.json(f"{root}/weibo/jsonl/search_contents_2026-01-0{day + 1}.jsonl")
    return io.read_crawl(spark, root, "weibo", "o_orderkey long, day long", limit=500)


# ---- records within records ------------------------------------------------------------------------------------------


@query("select conv_id as post_id, cast(turn as varchar) as comment_id, text from conversations")
def nested_comments(spark, sf):
    """Each conversation is one comment record with all later turns as its replies: a reply comes out for each of them."""
    turn = F.struct(F.col("turn").alias("id"), "text")
    turns = v.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("post_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    record = F.to_json(F.struct(F.get("t", F.lit(0))["id"].alias("id"), F.get("t", F.lit(0))["text"].alias("text"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("comments")))
    found = normalize.nested_comments(turns.select("post_id", record.alias("payload")))
    return found.select("post_id", F.get_json_object("payload", "$.id").alias("comment_id"), F.get_json_object("payload", "$.text").alias("text"))


@query("select cast(doc_id as varchar) as note_id, text from documents where doc_id % 4 <> 3")
def search_cards(spark, sf):
    """Documents as search cards: posts at the top, posts in groups of none to two next to other cards, and cards that are no posts."""
    d = v.table(spark, sf, "documents").select("doc_id", "text")
    post = lambda kind: F.to_json(F.struct(F.lit(kind).alias("card_type"), F.struct(F.col("doc_id").cast("string").alias("id"), "text").alias("mblog")))
    ad = F.to_json(F.struct(F.lit(4).alias("card_type")))
    top = d.where("doc_id % 4 in (0, 3)").select(F.when(F.col("doc_id") % 4 == 0, post(9)).otherwise(post(3)).alias("payload"))
    grouped = d.where("doc_id % 4 in (1, 2)").groupBy(F.floor(F.col("doc_id") / 4)).agg(F.collect_list(post(9)).alias("cards"))
    group = grouped.select(F.concat(F.lit('{"card_type":11,"card_group":['), F.array_join(F.concat(F.array(ad), F.col("cards")), ","), F.lit("]}")).alias("payload"))
    none = d.where("doc_id % 4 = 3").select(F.lit('{"card_type":11,"card_group":[]}').alias("payload"))
    found = normalize.weibo_cards(top.unionByName(group).unionByName(none))
    return found.select(F.get_json_object("payload", "$.mblog.id").alias("note_id"), F.get_json_object("payload", "$.mblog.text").alias("text"))


@query("select doc_id as note_id, case when doc_id % 4 = 0 then text else substr(text, 1, 40) end as content from documents")
def long_text_overlay(spark, sf):
    """Posts that were cut at forty characters, a quarter of them with their full text from a second request."""
    d = v.table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), "text")
    posts = d.select("note_id", F.substring("text", 1, 40).alias("content"))
    return normalize.overlay_long_text(posts, d.where("note_id % 4 = 0").withColumnRenamed("text", "content"))


@query("select o_orderpriority as keyword, count(*) as n from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 180 days group by 1")
def recent_posts(spark, sf):
    """Posts of the last 180 days before the latest one."""
    p = v.post(spark, sf)
    latest = p.agg(F.max("o_orderdate").alias("latest"))  # one row
    return p.join(F.broadcast(latest)).where(times.recent("o_orderdate", F.col("latest"), 180)).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
