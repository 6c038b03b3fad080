"""Queries of report drafts and search rows over the adapter views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import text as t
from ..operators import collect, coverage, decision, drafts, grounding, planner, report, responses, search, storage
from . import research as r
from . import views as v

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ids(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _case_sql(column: str, values: dict) -> str:
    return "case " + column + " " + " ".join(f"when '{a}' then '{b}'" for a, b in values.items()) + " end"


_NAME = _case_sql("platform", drafts.PLATFORM_NAMES)
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PLAIN = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"

# ---- labels and sentences --------------------------------------------------------------------------------------------


@query(
    f"with {v.SRC}, p as (select unnest([{', '.join(repr(p) for p in k.PLATFORMS)}]) as platform) select p.platform, {_NAME.replace('platform', 'p.platform')} as name, {_case_sql('p.platform', drafts.PLATFORM_ROLES)} as role, p.platform in ('bilibili', 'youtube') as transcripts, p.platform <> 'youtube' as crawled, count(source_id) as n from p left join src on src.platform = p.platform group by p.platform"
)
def platform_dimension(spark, sf):
    n = v.src(spark, sf).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))
    rows = F.broadcast(drafts.platform_dimension(spark)).join(n, "platform", "left")
    return rows.select("platform", "name", "role", "transcripts", "crawled", F.coalesce("n", F.lit(0)).alias("n"))


_KINDS = [*drafts.KIND_LABELS, "unheard-of"]


@query(
    f"""with {v.SRC}, q as (select source_id, [{', '.join(repr(x) for x in _KINDS)}][source_id % 8 + 1] as kind, coalesce({_STRIP.format('title')}, '') as clean from src)
select source_id, coalesce({_case_sql('kind', {a: b[0] for a, b in drafts.KIND_LABELS.items()})}, 'general research') as label, coalesce({_case_sql('kind', {a: b[1] for a, b in drafts.KIND_LABELS.items()})}, '通用研究') as label_zh, case when clean = '' then 'Untitled research' when length(clean) > 48 then substr(clean, 1, 48) || '...' else clean end as title from q"""
)
def draft_labels(spark, sf):
    rows = v.src(spark, sf).withColumn("kind", F.get(t.words(_KINDS), (F.col("source_id") % 8).cast("int")))
    return rows.select("source_id", drafts.kind_label("kind").alias("label"), drafts.kind_label("kind", True).alias("label_zh"), drafts.draft_title("title").alias("title"))


@query(
    f"""with {v.SRC}, c as (select conv_id, list(text order by turn) as texts from (select *, row_number() over (partition by conv_id order by turn) as nth from conversations where role = 'user') where nth <= 8 group by 1)
select source_id, sha256(array_to_string(list_concat([coalesce(title, ''), '', substr(coalesce(transcript, ''), 1, 420), substr(coalesce(transcript, ''), 1, 6000)], coalesce(texts, [])), ' ')) as text_sha256 from src left join c on c.conv_id = source_id"""
)
def decision_text(spark, sf):
    kept = collect.top_by(v.comments(spark, sf), ["source_id"], [F.col("pos")], 8, "nth").groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"))
    rows = v.src(spark, sf).join(kept, "source_id", "left")
    return rows.select("source_id", F.sha2(drafts.decision_text(F.substring("transcript", 1, 420), F.col("texts")), 256).alias("text_sha256"))


_CHANNELS = "concat_ws('、', case when title <> '' then 'title' end, case when n_comments > 0 then 'comments' end, case when transcript <> '' then 'transcript' end, case when url <> '' then 'url' end)"


@query(
    f"with {v.DECORATED} select source_id, platform || ' / ' || coalesce(nullif(creator, ''), 'creator') || ': ' || substr(coalesce(nullif(transcript, ''), nullif(title, ''), ''), 1, 110) || '; evidence score ' || evidence_score || ', channels: ' || coalesce(nullif({_CHANNELS}, ''), 'title') || '.' as signal from deco"
)
def source_signal(spark, sf):
    return r.decorated(spark, sf).withColumn("channels", collect.channels()).select("source_id", drafts.source_signal().alias("signal"))


_PLACE = _case_sql("platform", {p: f"{i:02d}" for i, p in enumerate(k.PLATFORMS)})


@query(
    f"""with {v.SRC}, {v.LOGS}, x as (select run_id, lower(coalesce(title, '') || ' ' || summary || ' ' || coalesce(transcript, '')) as x from src), rc as ({r._COUNTS}), risks as (select run_id, term, row_number() over (partition by run_id order by n desc, term) as rank from rc where n > 0 qualify rank <= 8),
n as (select run_id, platform, count(*) as n from src group by 1, 2)
select run_id, 'platforms' as part, 'Platform coverage: ' || string_agg({_NAME} || ' ' || n, ', ' order by n desc, {_PLACE}) || '. ' as sentence from n group by 1
union all select run_id, 'evidence', count(*) filter (where n_comments > 0) || ' source(s) include sampled comments and ' || count(*) filter (where coalesce(transcript, '') <> '') || ' include transcript/text snippets. ' from src group by 1
union all select run_id, 'risks', coalesce(string_agg(term, ', ' order by rank) filter (where rank <= 5), 'comment counterexamples, publish date and sample context') from (select distinct run_id from src) left join risks using (run_id) group by 1
union all select run_id, 'log', coalesce(any_value(good) || ' retrieval run(s) succeeded, ' || any_value(bad) || ' failed.', 'No live retrieval logs were produced.') from (select distinct run_id from src) left join (select run_id, count(*) filter (where ok) as good, count(*) filter (where not ok) as bad from logs group by 1) using (run_id) group by 1"""
)
def run_sentences(spark, sf):
    s = v.src(spark, sf)
    risks = report.risk_terms(s.select("run_id", F.concat_ws(" ", "title", "summary", "transcript").alias("text")), v.RISK)
    parts = {"platforms": drafts.platform_sentence(s), "evidence": drafts.evidence_sentence(s), "risks": drafts.risk_sentence(s, risks), "log": drafts.log_sentence(s, v.logs(spark, sf))}
    return reduce(DataFrame.unionByName, (df.withColumn("part", F.lit(name)) for name, df in parts.items()))


@query()
def sentence_chunks(spark, sf):
    rows = v.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(drafts.sentence_chunks("text")).alias("chunk", "text"))
    return rows


_HINTED = "coalesce(text, '') || case item_id % 4 when 0 then ' budget 4500 元, commute and office' when 1 then ' 通勤 夜景 游戏 户外' when 2 then ' 12 and 1234567' else '' end"
_SCENES = "list_filter([{0}], lambda w: contains(lower(x), lower(w)))".format(", ".join(f"'{w}'" for w in k.SCENARIO_WORDS))


@query(f"with b as (select item_id, {_HINTED} as x from benchmark), h as (select item_id, array_to_string({_SCENES}[1:3], ', ') as c, regexp_extract(x, '(\\d{{3,6}})', 1) as n from b) select item_id, case when c = '' then 'Verify scenario in source' else c end as condition, case when n = '' then 'budget not explicit' else 'budget around ' || n end as budget from h")
def decision_hints(spark, sf):
    b = v.table(spark, sf, "benchmark").select("item_id", F.expr(_HINTED).alias("x"))
    return b.select("item_id", drafts.condition_text("x").alias("condition"), drafts.budget_hint("x").alias("budget"))


@query(
    rf"""with d as (select source_id, case when source_id % 3 = 0 then substr('降噪音质续航佩戴舒适价格', 1 + source_id % 7, 2 + source_id % 4) else coalesce(title, '') end as x from ({v.SRC.replace('src as', 'with src as')} select * from src)),
e as (select source_id, x, substr(trim(regexp_replace(lower(x), '[^a-zA-Z0-9_-]+', '-', 'g'), '-'), 1, 48) as plain, list_sum(list_transform(range(1, length(x) + 1), lambda i: i * unicode(substr(x, i, 1)))) % 100000 as code from d)
select source_id, case when regexp_matches(x, '[一-鿿]') then 'dim-' || cast(code as bigint) when plain = '' then 'dimension' else plain end as dimension_key from e"""
)
def dimension_keys(spark, sf):
    i = F.col("source_id")
    x = F.when(i % 3 == 0, F.substring(F.lit("降噪音质续航佩戴舒适价格"), 1 + i % 7, 2 + i % 4)).otherwise(F.coalesce("title", F.lit("")))
    return v.src(spark, sf).select("source_id", drafts.dimension_key(x).alias("dimension_key"))


# ---- claims, stages, gates -------------------------------------------------------------------------------------------

_REPORTED = f"""{r._BLOCKS}, tk as (select run_id, 0 as part, pos, text, 'takeaway' as claim_type, citations as cited from blocks where block_type = 'takeaway'),
ins as (select run_id, 1 as part, pos, text, 'insight:risk' as claim_type, citations as cited from blocks where block_type = 'bullet'),
cl as (select run_id, part, pos, regexp_replace({_STRIP.format('text')}, '\\s+', ' ', 'g') as claim_text, claim_type, cited from (select * from tk union all select * from ins)),
f1 as (select * from cl where claim_text <> '' qualify row_number() over (partition by run_id, claim_text order by part, pos) = 1), f2 as (select *, row_number() over (partition by run_id order by part, pos) as claim_no from f1 qualify claim_no <= 12),
un as (select source_id, arg_max(source_id * 1000 + turn, turn) as unit_id from (select conv_id as source_id, turn from conversations) group by 1),
lk as (select run_id, claim_no, nc, source_id, unit_id from (select run_id, claim_no, unnest(cited) as source_id, generate_subscripts(cited, 1) as nc from f2) join un using (source_id))"""


def _claims(spark, sf):
    blocks = r._blocks(spark, sf)
    takeaways = blocks.where("block_type = 'takeaway'").select("run_id", "pos", "text", "citations")
    insights = blocks.where("block_type = 'bullet'").select("run_id", "pos", F.lit("risk").alias("kind"), F.col("text").alias("summary"), F.col("citations").alias("source_ids"))
    units = v.segments(spark, sf).join(v.src(spark, sf).select("source_id", "run_id"), "source_id").select("run_id", "source_id", (F.col("source_id") * 1000 + F.col("pos")).alias("unit_id"), "pos")
    return drafts.claims_from_report(takeaways, insights, units)


@query(f"with {_REPORTED}, u as (select run_id, claim_no, string_agg(cast(source_id as varchar), ',' order by nc) as s, string_agg(cast(unit_id as varchar), ',' order by nc) as u from lk group by 1, 2) select f2.run_id, f2.claim_no, claim_text, claim_type, coalesce(s, '') as source_ids, coalesce(u, '') as unit_ids from f2 left join u on u.run_id = f2.run_id and u.claim_no = f2.claim_no")
def claims_from_report(spark, sf):
    return _claims(spark, sf)[0].withColumn("source_ids", _ids("source_ids")).withColumn("unit_ids", _ids("unit_ids"))


@query(f"with {_REPORTED} select run_id, claim_no, unit_id, 'insufficient' as relation from lk")
def claim_links(spark, sf):
    return _claims(spark, sf)[1]


_STATUS = "case when sources = 0 then 'failed' when warnings <> '' then 'partial' else 'completed' end"
_STATES = f"""{r._COVER}, w0 as (select run_id, sources, concat_ws(',', case when sources = 0 then 'no_sources' end, case when runs_failed > 0 then 'providers_failed' end, case when sources > 0 and platforms = 1 then 'one_platform' end, case when sources > 0 and with_comments = 0 and with_transcripts = 0 then 'metadata_only' end) as warnings from summary),
st as (select run_id, sources, {_STATUS} as status from w0 union all select run_id + 100, 0, case when run_id % 2 = 0 then 'failed' else 'running' end from w0)"""


@query(
    f"""with {_STATES}, d as (select *, status in ('completed', 'partial') as done from st)
select run_id, 'plan' as stage, 'Plan query' as label, 'completed' as status, 100 as progress, '' as message from d union all select run_id, 'search', 'Search sources', case when done then 'completed' else status end, case when sources > 0 then 100 else 45 end, sources || ' sources' from d
union all select run_id, 'evidence', 'Structure evidence', case when done then 'completed' else status end, case when sources > 0 then 100 else 30 end, '' from d union all select run_id, 'synthesis', 'Synthesize report', case when done then 'completed' else status end, case when done then 100 else 30 end, '' from d"""
)
def stage_rows(spark, sf):
    summary = r._summary(spark, sf)
    known = summary.select("run_id", "sources").join(report.run_warnings(summary).select("run_id", "status"), "run_id")
    bare = known.select(F.col("run_id") + 100, F.lit(0).cast("long"), F.when(F.col("run_id") % 2 == 0, "failed").otherwise("running"))
    return drafts.stage_rows(known.union(bare))


@query(
    f"""with {v.SRC}, {v.LOGS}, cat as (select run_id, unnest([{', '.join(repr(p) for p in v.PLATFORMS)}]) as platform from (select distinct run_id from src)), n as (select run_id, platform, count(*) as n, count(*) filter (where citation_count > 0) as cited from src group by 1, 2), l as (select run_id, platform, bool_and(not ok) as bad from logs group by 1, 2)
select cat.run_id, cat.platform, coalesce(n, 0) as n, coalesce(cited, 0) as cited, case when coalesce(n, 0) > 0 then 'completed' when coalesce(bad, false) then 'failed' else 'partial' end as status from cat left join n on n.run_id = cat.run_id and n.platform = cat.platform left join l on l.run_id = cat.run_id and l.platform = cat.platform"""
)
def source_groups(spark, sf):
    s = v.src(spark, sf)
    return drafts.source_groups(report.platform_summaries(s, v.logs(spark, sf), s), s)


@query(f"with {_REPORTED}, s as (select run_id, count(*) as n from src group by 1), u as (select run_id, count(*) as n from conversations join src on source_id = conv_id group by 1), c as (select run_id, count(*) as n from f2 group by 1), l as (select run_id, count(*) as n from lk group by 1) select s.run_id, s.n as sources, coalesce(u.n, 0) as units, coalesce(c.n, 0) as claims, coalesce(l.n, 0) as links from s left join u using (run_id) left join c using (run_id) left join l using (run_id)")
def manifest_counts(spark, sf):
    s = v.src(spark, sf)
    claims, links = _claims(spark, sf)
    units = v.segments(spark, sf).join(s.select("source_id", "run_id"), "source_id")
    return drafts.manifest_counts({"sources": s, "units": units, "claims": claims, "links": links})


_GATED = f"""{r._GATE}, gate as (select run_id, counter_sources > 0 as counter_found, run_id % 3 = 1 as blocked from g),
rel as (select claim_id % 7 as run_id, count(*) filter (where relation = 'support') as support, count(*) filter (where relation = 'contradict') as contradict, count(*) filter (where relation = 'insufficient') as insufficient from ({'{verdict}'}) group by 1)"""
_JUDGED = "select item_id as claim_id, case item_id % 3 when 0 then 'support' when 1 then 'contradict' else 'insufficient' end as relation from benchmark"


def _gated(spark, sf):
    """Gates, some of them blocked, and relations of seven of the ten runs."""
    b = v.table(spark, sf, "benchmark").select((F.col("item_id") % 7).alias("run_id"), F.expr("case item_id % 3 when 0 then 'support' when 1 then 'contradict' else 'insufficient' end").alias("relation"))
    return r._gate(spark, sf).select("run_id", "counter_found").withColumn("blocked", F.col("run_id") % 3 == 1), grounding.relation_counts(b, ["run_id"])


_GATED = _GATED.replace("{verdict}", _JUDGED)


@query(
    f"""with {_GATED} select gate.run_id, concat_ws(' / ', case when blocked then '{drafts.WARN_BLOCKED}' end, case when not counter_found then '{drafts.WARN_COUNTER}' end,
  case when coalesce(insufficient, 0) + coalesce(contradict, 0) > 0 then 'Claim grounding review: ' || insufficient || ' insufficient and ' || contradict || ' contradictory claim results.' end) as warnings from gate left join rel on rel.run_id = gate.run_id"""
)
def gate_warnings(spark, sf):
    return drafts.gate_warnings(*_gated(spark, sf)).withColumn("warnings", F.array_join("warnings", " / "))


@query(
    f"""with {_GATED} select run_id, 'coverage_gate' as step, case when blocked then 'partial' else 'ok' end as status, case when blocked then 'LLM synthesis blocked by severe coverage gaps; deterministic reporting remains available.' else 'Coverage gate allows report synthesis.' end as message from gate
union all select run_id, 'claim_verifier', case when insufficient + contradict > 0 then 'partial' else 'ok' end, 'Verified ' || (support + contradict + insufficient) || ' final report claims with relation-level grounding results.' from rel"""
)
def gate_traces(spark, sf):
    return drafts.gate_traces(*_gated(spark, sf))


@query(
    f"""with {v.SRC}, w as (select user_id % 10 as run_id, event_id as pos, {v._PLATFORM_SQL.format('event_id')} as p, event_type from events), named as (select run_id, pos, p as platform, upper(p) || ' failed: ' || event_type as text from w),
have as (select distinct run_id, platform from src where source_id % 4 = 1) select run_id, platform, arg_max(text, pos) as message from named where not exists (select 1 from have where have.run_id = named.run_id and have.platform = named.platform) group by 1, 2"""
)
def failed_platforms(spark, sf):
    e = v.table(spark, sf, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("event_id").alias("pos"), F.concat(F.upper(v._platform("event_id")), F.lit(" failed: "), "event_type").alias("text"))
    counts = v.src(spark, sf).where("source_id % 4 = 1").groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    return drafts.failed_platforms(e, counts)


# ---- layouts ---------------------------------------------------------------------------------------------------------

_TERMS = ", ".join(repr(x) for x in r._SIGNALS)
_LAYOUT = f"""{r._BLOCKS}, terms as (select distinct run_id, unnest([{_TERMS}]) as term from src), sx as (select *, lower(coalesce(title, '') || ' ' || coalesce(transcript, '')) as txt, lower(coalesce(title, '') || ' ' || summary || ' ' || substr(coalesce(transcript, ''), 1, 420)) as hh from src),
hs as (select sx.*, term, row_number() over (partition by sx.run_id, term order by source_id) as nth from sx join terms on terms.run_id = sx.run_id and contains(hh, term)),
sg as (select run_id, term, least(5, 2 + count(*) filter (where {r._any('txt', v.POSITIVE)})) as support, least(5, 2 + count(*) filter (where {r._any('txt', v.RISK)})) as risk, list(source_id order by source_id) filter (where nth <= 4) as evidence from hs group by 1, 2),
sr as (select *, row_number() over (partition by run_id order by support desc, term) as nth from sg), pn as (select run_id, platform, count(*) as n from src group by 1, 2), pr as (select *, row_number() over (partition by run_id order by n desc, platform) as nth from pn),
rb as (select run_id, pos as rank, regexp_extract(text, '''(.*)''', 1) as term, citations from blocks where section_id = 'risks'), es as (select run_id, count(*) filter (where n_comments > 0) || ' source(s) include sampled comments and ' || count(*) filter (where coalesce(transcript, '') <> '') || ' include transcript/text snippets. ' as text from src group by 1)"""
_SHOW = "select run_id, section_id, block_type, cast(section_no as integer) as section_no, cast(pos as integer) as pos, text, array_to_string(citations, ',') as citations from lb"


def _shown(blocks: DataFrame) -> DataFrame:
    return blocks.select("run_id", "section_id", "block_type", "section_no", F.col("pos").cast("int").alias("pos"), "text", _ids("citations").alias("citations"))


def _drafted(spark, sf, head=None):
    s = r.decorated(spark, sf, head)
    risks = r._risks(spark, sf)
    summary = drafts.evidence_sentence(s).select("run_id", F.lit(0).alias("pos"), F.col("sentence").alias("text"), F.array().cast("array<bigint>").alias("citations"))
    return s, summary, report.risk_bullets(s, risks)


@query(
    f"""with {_LAYOUT}, lb as (select run_id, 'executive_summary' as section_id, 'body' as block_type, 0 as section_no, 0 as pos, text, [] as citations from es
union all select run_id, 'market_signals', 'bullet', 1, nth, term || ': support ' || support || '/5, risk ' || risk || '/5', evidence from sr union all select run_id, 'competitors', 'bullet', 2, nth, {_NAME} || ': ' || n || ' sources', [] from pr
union all select run_id, 'opportunities', 'bullet', 3, nth, 'Look into ''' || term || '''', evidence from sr where support >= 4 union all select run_id, 'risks', 'bullet', 4, rank, 'Check ''' || term || '''', citations from rb) {_SHOW}"""
)
def business_blocks(spark, sf):
    s, summary, risks = _drafted(spark, sf)
    texts = s.withColumn("text", F.concat_ws(" ", "title", "transcript"))
    terms = s.select("run_id").distinct().select("run_id", F.explode(t.words(r._SIGNALS)).alias("term"))
    signals = collect.top_by(report.signal_rows(texts, terms, v.POSITIVE, v.RISK), ["run_id"], [F.col("support").desc(), F.col("term")], 100, "nth")
    platforms = collect.top_by(s.groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("n")), ["run_id"], [F.col("n").desc(), F.col("platform")], 100, "nth")
    return _shown(drafts.business_blocks(summary, signals, platforms, signals.where("support >= 4"), risks))


@query(
    f"""with {_LAYOUT}, tp as (select top.*, d.url, d.platform || ' / ' || coalesce(nullif(d.creator, ''), 'creator') || ': ' || substr(coalesce(nullif(d.transcript, ''), nullif(d.title, ''), ''), 1, 110) || '; evidence score ' || d.evidence_score || ', channels: ' || coalesce(nullif({_CHANNELS.replace('title', 'd.title').replace("'d.title'", "'title'").replace('n_comments', 'd.n_comments').replace('when transcript', 'when d.transcript').replace('when url', 'when d.url')}, ''), 'title') || '.' as signal from top join deco d on d.run_id = top.run_id and d.source_id = top.source_id),
lb as (select run_id, 'answer' as section_id, 'body' as block_type, 0 as section_no, 0 as pos, text, [] as citations from es union all select run_id, 'top_picks', 'bullet', 1, rank, rank || '. ' || title, [source_id] from tp where rank <= 3 union all select run_id, 'good_to_know', 'bullet', 2, rank, signal, [source_id] from tp where rank <= 3
union all select run_id, 'avoid', 'bullet', 3, rank, 'Avoid or check ''' || term || '''', citations from rb union all select run_id, 'next_steps', 'bullet', 4, rank, 'Open ' || url, [source_id] from tp where rank between 4 and 6) {_SHOW}"""
)
def consumer_blocks(spark, sf):
    s, summary, risks = _drafted(spark, sf, r.HEAD)
    top = collect.top_sources(s).withColumn("channels", collect.channels()).withColumn("signal", drafts.source_signal())
    return _shown(drafts.consumer_blocks(summary, top, risks))


_CELLS = rf"""{r._SCORED}, mt as (select m.run_id, m.key, c.name as candidate, m.source_id, x.txt from (select distinct run_id, key, source_id from named) m join chosen c on c.run_id = m.run_id and c.key = m.key join x on x.run_id = m.run_id and x.source_id = m.source_id),
hl as (select matrix.run_id, matrix.key, matrix.term, candidate, source_id, txt, contains(lower(txt), matrix.term) as holds from matrix join mt on mt.run_id = matrix.run_id and mt.key = matrix.key),
h4 as (select *, row_number() over (partition by run_id, key, term order by holds desc, source_id) as nth from hl qualify nth <= 4 and (holds or nth = 1)),
h5 as (select *, case when holds then list_filter(string_split_regex(regexp_replace(txt, '([。！？.!?])\s*', '\1' || chr(10), 'g'), '[\n\r]+'), lambda s: contains(lower(s), term))[1] end as raw from h4),
h6 as (select run_id, key, term, max(candidate) as candidate, arg_min(regexp_replace({_STRIP.format('raw')}, '\s+', ' ', 'g'), nth) as snip, list_sort(list(source_id)) as source_ids, string_agg(substr(txt, 1, 800), ' ' order by nth) as x from h5 group by 1, 2, 3),
mc as (select run_id, key, term, case when coalesce(snip, '') <> '' then candidate || ' evidence on ''' || term || ''': ' || substr(snip, 1, 140) else 'Direct evidence for ' || candidate || ' on ''' || term || ''' is thin; treat as weak evidence.' end as conclusion, coalesce(nullif(array_to_string({_SCENES}[1:3], ', '), ''), 'Verify scenario in source') as condition, source_ids from h6)"""


def _cells(spark, sf):
    s, chosen, terms = r._dimensions(spark, sf)
    conflicts = storage.written(decision.contradictions(s, terms, v.POSITIVE, v.RISK))
    matrix = storage.written(decision.dimension_matrix(s, r._named(spark, sf), chosen, terms, conflicts))
    return chosen, terms, conflicts, matrix, drafts.matrix_cells(s, r._named(spark, sf), chosen, matrix)


@query(f"with {_CELLS} select run_id, key, term, conclusion, condition, array_to_string(source_ids, ',') as source_ids from mc")
def matrix_cells(spark, sf):
    return _cells(spark, sf)[4].withColumn("source_ids", _ids("source_ids"))


@query(f"with {_CELLS}, e as (select distinct run_id, unnest(source_ids) as s from mc) select run_id, string_agg(cast(s as varchar), ',' order by s) as source_ids from e group by 1")
def compared_ids(spark, sf):
    return drafts.compared_ids(_cells(spark, sf)[4]).withColumn("source_ids", _ids("source_ids"))


_NEED_TEXT = "'I understand your need as: budget around 4500, making a purchase decision for ''headphones under 4500''. The dimensions to confirm are ' || coalesce(dl, 'repeated product attributes from sources') || '. Please verify budget, use case and unacceptable trade-offs. Current confidence: medium.'"


@query(
    f"""with {_CELLS}, nd as (select c.run_id, string_agg(term, ', ' order by d.rank) filter (where d.rank <= 5) as dl from (select distinct run_id from chosen) c left join dims d on d.run_id = c.run_id group by 1),
tot as (select c.run_id, c.key, n_sources * 3 + coalesce(points, 0) as total, rank from chosen c left join pts using (run_id, key)), pl as (select *, row_number() over (partition by run_id order by total desc, rank) as place, count(*) over (partition by run_id) as n from tot),
pk as (select *, case when place = 1 then 'primary' when place = 2 then 'backup' when place = n and n > 2 then 'caution' else '' end as pick from pl),
lb as (select run_id, 'need' as section_id, 'body' as block_type, 0 as section_no, 0 as pos, {_NEED_TEXT} as text, [] as citations from nd union all select run_id, 'candidates', 'bullet', 1, rank, name || ' (' || n_sources || ' sources)', [] from chosen
union all select run_id, 'comparison', 'bullet', 2, row_number() over (partition by run_id order by key, term), conclusion, source_ids from mc union all select run_id, 'recommendation', 'bullet', 3, place, pick || ': ' || key, [] from pk where pick <> ''
union all select run_id, 'contradictions', 'bullet', 4, row_number() over (partition by run_id order by term), 'Sources disagree on ''' || term || '''', [] from conflicts where positive and negative) {_SHOW}"""
)
def decision_blocks(spark, sf):
    chosen, terms, conflicts, matrix, cells = _cells(spark, sf)
    listed = terms.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("dims"))
    need = chosen.select("run_id").distinct().join(listed, "run_id", "left").withColumn("dims", F.coalesce("dims", F.array().cast("array<string>")))
    need = need.select("run_id", drafts.need_summary(F.lit("headphones under 4500"), F.col("dims"), F.lit("medium")).alias("text"))
    return _shown(drafts.decision_blocks(need, chosen, cells, decision.recommendation(chosen, matrix), conflicts))


# ---- command-line report and views -----------------------------------------------------------------------------------

_LINES = f"""{v.SRC}, w as (select run_id, lower({r._WORDS.format('title')}) as word from src), wn as (select run_id, word, count(*) as n from w where length(word) > 1 and word not in ({r._STOP}) group by 1, 2), kw as (select run_id, word, row_number() over (partition by run_id order by n desc, word) as rank from wn qualify rank <= 8),
n as (select run_id, platform, count(*) as n from src group by 1, 2), tot as (select run_id, sum(n) as items, string_agg(platform || ' ' || n, ', ' order by n desc, platform) as platforms from n group by 1), tm as (select run_id, string_agg(word, ', ' order by rank) as terms from kw group by 1)"""


@query(f"with {_LINES} select run_id, cast(items as bigint) as items, platforms, coalesce(terms, '') as terms from tot left join tm using (run_id)")
def conclusion_lines(spark, sf):
    return drafts.conclusion_lines(v.src(spark, sf), stop_words=v.STOP)


_MD = r"replace(regexp_replace(replace(coalesce({0}, ''), '|', '\|'), '[\r\n]+', ' ', 'g'), chr(0), '')"


@query(
    f"""with {v.SRC}, {v.LOGS}, it as (select *, row_number() over (partition by run_id order by source_id) as nth from src qualify nth <= 50), tb as (select run_id, string_agg('| ' || source_id || ' | ' || platform || ' | ' || {_MD.format('title')} || ' | ' || url || ' |', chr(10) order by nth) as t from it group by 1),
pn as (select run_id, platform, count(*) as n from src group by 1, 2), nt as (select run_id, string_agg('- ' || {_NAME} || ': ' || n || ', ok', chr(10) order by platform) as t from pn group by 1), lg as (select run_id, platform, count(*) filter (where ok) as g, count(*) filter (where not ok) as b from logs group by 1, 2),
ll as (select run_id, string_agg('| ' || platform || ' | ' || g || ' | ' || b || ' |', chr(10) order by platform) as t from lg group by 1)
select tb.run_id, sha256('# Run ' || tb.run_id || chr(10) || chr(10) || '## Resources' || chr(10) || chr(10) || '| # | Platform | Title | Address |' || chr(10) || '|-|-|-|-|' || chr(10) || tb.t || chr(10) || chr(10) || '## Platforms' || chr(10) || chr(10) || nt.t || chr(10) || chr(10) || '## Run log' || chr(10) || chr(10) || '| Platform | Good | Failed |' || chr(10) || '|-|-|-|' || chr(10) || coalesce(ll.t, '') || chr(10)) as markdown_sha256 from tb join nt using (run_id) left join ll using (run_id)"""
)
def markdown_report(spark, sf):
    s = v.src(spark, sf).withColumn("display_id", F.col("source_id"))
    runs = s.select("run_id").distinct().withColumn("title", F.concat(F.lit("Run "), F.col("run_id").cast("string")))
    platforms = s.groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("n")).select("run_id", "platform", "n", F.lit("ok").alias("status"), F.lit("").alias("note"))
    return drafts.markdown_report(runs, s, platforms, v.logs(spark, sf)).select("run_id", F.sha2("markdown", 256).alias("markdown_sha256"))


@query(f"with {v.SRC} select run_id, source_id, row_number() over (partition by run_id order by source_id % 3 <> 0, source_id) as rank from src qualify rank <= 4")
def cover_first(spark, sf):
    s = v.src(spark, sf).withColumn("cover", F.when(F.col("source_id") % 3 == 0, F.col("url")))
    return drafts.cover_first(s).select("run_id", "source_id", "rank")


@query(f"with {_LINES} select run_id, cast(items as bigint) as items, platforms, coalesce(terms, '') as terms from tot left join tm using (run_id) where run_id < 5 union all select run_id, cast(items as bigint), platforms, 'second' from tot where run_id >= 5")
def report_records(spark, sf):
    """Records are written, some of them again, and opened by run."""
    import uuid

    path = f"{storage.shared_dir(spark)}/records-{uuid.uuid4().hex}"
    lines = conclusion_lines(spark, sf)
    drafts.save_records(lines, path)
    drafts.save_records(lines.where("run_id >= 5").withColumn("terms", F.lit("second")), path)
    return drafts.read_records(spark, path)


# ---- search rows -----------------------------------------------------------------------------------------------------


def _raw(spark, sf):
    return v.src(spark, sf).withColumn("i", F.col("source_id").cast("string"))


@query(
    rf"""with {v.SRC}, b as (select *, coalesce(nullif({_STRIP.format('title')}, ''), 'Untitled') as ti from src) select source_id as pos, case when source_id % 2 = 0 then 'youtube' else 'bilibili' end as platform, case when source_id % 2 = 0 then 'v' || source_id else 'BV' || source_id end as object_id,
  case when source_id % 5 = 0 then url when source_id % 2 = 0 then 'https://www.youtube.com/watch?v=v' || source_id else 'https://www.bilibili.com/video/BV' || source_id end as url, {_PLAIN.format('ti')} as title, coalesce({_STRIP.format('creator')}, '') as creator, published, cast(case when source_id % 3 = 0 then (source_id % 90) * 10000 else source_id end as bigint) as views from b"""
)
def search_sources(spark, sf):
    i = F.col("i")
    views = F.when(F.col("source_id") % 3 == 0, F.concat((F.col("source_id") % 90).cast("string"), F.lit("万"))).otherwise(i)
    given = F.when(F.col("source_id") % 5 == 0, F.col("url"))
    tube = F.to_json(F.struct(F.concat(F.lit("v"), i).alias("videoId"), "title", F.col("creator").alias("channelName"), F.col("published").alias("publishedTime"), views.alias("viewCount"), given.alias("href")))
    bili = F.to_json(F.struct(F.concat(F.lit("BV"), i).alias("bvId"), F.col("title").alias("name"), F.col("creator").alias("up"), F.col("published").alias("pubdate"), views.alias("play"), given.alias("link")))
    even = F.col("source_id") % 2 == 0
    rows = _raw(spark, sf).select(F.when(even, "youtube").otherwise("bilibili").alias("platform"), F.col("source_id").alias("pos"), F.when(even, tube).otherwise(bili).alias("row"))
    return search.search_sources(rows).select("pos", "platform", "object_id", "url", "title", "creator", "published", "views")


@query(
    rf"""with {v.SRC}, b as (select *, coalesce(nullif({_STRIP.format('title')}, ''), 'Untitled') as ti from src) select source_id as pos, case when source_id % 4 = 0 then url else 'https://www.youtube.com/watch?v=p' || source_id end as url, {_PLAIN.format('ti')} as title, coalesce({_STRIP.format('creator')}, '') as creator from b"""
)
def playlist_sources(spark, sf):
    own = F.col("source_id") % 4 != 0
    row = F.to_json(F.struct(F.when(own, F.concat(F.lit("p"), "i")).alias("id"), F.when(~own, F.col("url")).alias("url"), "title", F.col("creator").alias("uploader")))
    return search.playlist_sources(_raw(spark, sf).select(F.col("source_id").alias("pos"), row.alias("row"))).select("pos", "url", "title", "creator")


@query(
    rf"""with {v.SRC}, b as (select *, coalesce(nullif({_STRIP.format('title')}, ''), 'Untitled') as ti from src) select source_id as pos, 'a' || source_id as object_id, 'https://www.youtube.com/watch?v=a' || source_id as url, {_PLAIN.format('ti')} as title, coalesce({_STRIP.format('creator')}, '') as creator,
  case when source_id % 3 = 0 then '' when source_id % 2 = 0 then 'http://i/h' || source_id else 'http://i/d' || source_id end as thumbnail, cast(case when source_id % 3 <> 0 then source_id * 7 end as bigint) as views from b"""
)
def api_sources(spark, sf):
    i = F.col("i")
    own = F.struct("title", F.col("creator").alias("channelTitle"))
    found = _raw(spark, sf).select(F.col("source_id").alias("pos"), F.to_json(F.struct(F.struct(F.concat(F.lit("a"), i).alias("videoId")).alias("id"), own.alias("snippet"))).alias("row"))
    high = F.when(F.col("source_id") % 2 == 0, F.struct(F.concat(F.lit("http://i/h"), i).alias("url")))
    small = F.struct(F.concat(F.lit("http://i/d"), i).alias("url"))
    snippet = F.struct("title", F.struct(high.alias("high"), small.alias("default")).alias("thumbnails"))
    details = _raw(spark, sf).where("source_id % 3 != 0").select(F.to_json(F.struct(F.concat(F.lit("a"), i).alias("id"), snippet.alias("snippet"), F.struct((F.col("source_id") * 7).cast("string").alias("viewCount")).alias("statistics"))).alias("row"))
    return search.api_sources(found, details).select("pos", "object_id", "url", "title", "creator", "thumbnail", "views")


@query(
    rf"""with c as (select conv_id as source_id, turn as pos, role, coalesce({_STRIP.format('text')}, '') as x from conversations) select source_id, pos, 'flat' as form, role as author, {_PLAIN.format('x')} as text, cast(pos * 1000 as bigint) as likes from c
union all select source_id, pos, 'thread', role, {_PLAIN.format('x')}, cast(pos as bigint) from c where {_PLAIN.format('x')} <> ''"""
)
def search_comments(spark, sf):
    c = v.table(spark, sf, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), "role", "text")
    flat = F.to_json(F.struct(F.col("role").alias("nickname"), F.col("text").alias("content"), F.concat(F.col("pos").cast("string"), F.lit("k")).alias("like_count")))
    inner = F.struct(F.col("role").alias("authorDisplayName"), F.col("text").alias("textDisplay"), F.col("pos").alias("likeCount"))
    thread = F.to_json(F.struct(F.struct(F.struct(inner.alias("snippet")).alias("topLevelComment")).alias("snippet")))
    columns = ("source_id", "pos", "form", "author", "text", "likes")
    one = search.comment_rows(c.withColumn("row", flat)).withColumn("form", F.lit("flat")).select(*columns)
    return one.unionByName(search.api_threads(c.withColumn("row", thread)).withColumn("form", F.lit("thread")).select(*columns))


@query(
    rf"""with {v.SRC}, b as (select *, {_PLAIN.format("coalesce(" + _STRIP.format('title') + ", '')")} as ti from src) select platform, cast(source_id as varchar) as item_id, case when length(ti) > 80 then substr(ti, 1, 80) || '...' when ti = '' then 'Untitled' else ti end as title, url, coalesce({_STRIP.format('creator')}, '') as author,
  concat_ws(', ', case when source_id % 2 = 0 then 'comments: ' || n_comments end, 'likes: ' || source_id) as metrics from b"""
)
def cli_items(spark, sf):
    even = F.col("source_id") % 2 == 0
    row = F.to_json(F.struct(F.when(even, F.col("i")).alias("note_id"), F.when(~even, F.col("i")).alias("aweme_id"), F.col("title").alias("desc"), F.col("url").alias("note_url"), F.col("creator").alias("nickname"), F.col("i").alias("liked_count"), F.when(even, F.col("n_comments").cast("string")).alias("comment_count")))
    return search.cli_items(_raw(spark, sf).select("platform", row.alias("row"))).select("platform", "item_id", "title", "url", "author", "metrics")


@query(f"with {v.SRC}, f as (select source_id, 'note' || source_id as key from src where source_id % 3 <> 1) select source_id as pos, key, case when source_id % 2 = 0 then url end as url from f join src using (source_id)")
def search_details(spark, sf):
    key = F.concat(F.lit("note"), F.col("source_id").cast("string")).alias("key")
    s = v.src(spark, sf)
    found = s.where("source_id % 3 != 1").select(F.col("source_id").alias("pos"), key)
    return search.with_details(found, s.where("source_id % 2 = 0").select(key, "url"), "key").select("pos", "key", "url")


_KIND = "case source_id % 5 when 0 then 'rec_query' when 1 then 'hot_query' when 2 then 'note' when 3 then 'video' end"


@query(f"with {v.SRC}, s as (select source_id, {_KIND} as kind, case source_id % 4 when 0 then 'HTTPS://a/b' when 1 then 'file:///a' when 2 then '/a/b' else 'http://c' end as value, case when source_id % 3 = 0 then 'licence' end as basis from src) select 'media' as rule, source_id from s where source_id % 4 in (1, 2) or basis is not null union all select 'local', source_id from s where source_id % 4 in (1, 2) union all select 'searched', source_id from s where kind is null or kind not in ('rec_query', 'hot_query') union all select 'videos', source_id from s where kind = 'video'")
def row_filters(spark, sf):
    s = v.src(spark, sf).select("source_id", F.expr(_KIND).alias("kind"), F.expr("case source_id % 4 when 0 then 'HTTPS://a/b' when 1 then 'file:///a' when 2 then '/a/b' else 'http://c' end").alias("value"), F.expr("case when source_id % 3 = 0 then 'licence' end").alias("rights_basis"))
    parts = {"media": search.permitted_media(s), "local": search.permitted_media(s, False), "searched": search.without_recommended(s, "kind"), "videos": search.of_kind(s, "video")}
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("rule"), "source_id") for name, df in parts.items()))


@query(f"with {v.SRC}, s as (select *, source_id % 37 as likes from src), o as (select 'popularity' as ordering, run_id, source_id, row_number() over (partition by run_id order by likes desc, n_comments desc, source_id) as rank from s union all select 'latest', run_id, source_id, row_number() over (partition by run_id order by published desc, source_id) from s union all select 'general', run_id, source_id, row_number() over (partition by run_id order by source_id) from s) select * from o where rank <= 20")
def search_orders(spark, sf):
    s = v.src(spark, sf).withColumn("likes", F.col("source_id") % 37)
    return reduce(DataFrame.unionByName, (search.search_order(s, o, 20).select(F.lit(o).alias("ordering"), "run_id", "source_id", "rank") for o in ("popularity", "latest", "general")))


@query(f"with {v.SRC}, p as (select *, row_number() over (partition by run_id order by source_id) as position from src qualify position <= 50) select run_id, source_id, row_number() over (partition by run_id, platform order by position) <= 2 as enrich from p")
def detail_limit(spark, sf):
    return search.detailed_first(v.src(spark, sf), 2).select("run_id", "source_id", "enrich")


@query(f"with {v.SRC} select 'with' as facet, platform, count(*) as n from src where platform = 'youtube' and source_id % 3 = 0 group by 2 union all select 'without', platform, count(*) from src where platform = 'weibo' and source_id % 3 <> 0 group by 2 union all select 'all', platform, count(*) from src where url <> '' group by 2")
def cover_facets(spark, sf):
    s = v.src(spark, sf).withColumn("cover", F.when(F.col("source_id") % 3 == 0, F.col("url")))
    parts = {"with": search.faceted(s, "youtube", True), "without": search.faceted(s, "weibo", False), "all": search.with_url(search.faceted(s))}
    return reduce(DataFrame.unionByName, (df.groupBy("platform").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("facet"), "platform", "n") for name, df in parts.items()))


def _script(head: str, body, tail: str = "</script></html>"):
    return F.concat(F.lit(f"<html><script{head}"), body, F.lit(tail))


@query(rf"with {v.SRC} select source_id as page_id, 'n' || source_id as note_id, coalesce({_STRIP.format('title')}, '') as title, coalesce({_STRIP.format('creator')}, '') as author, cast(source_id * 10 as bigint) as likes from src union all select source_id, 'creator', coalesce({_STRIP.format('creator')}, ''), 'is undefined', null from src where source_id % 2 = 0")
def page_notes(spark, sf):
    note = F.struct(F.struct("title", F.struct(F.col("creator").alias("nickname")).alias("user"), F.struct((F.col("source_id") * 10).cast("string").alias("likedCount")).alias("interactInfo")).alias("note"))
    state = F.concat(F.lit('{"note":{"noteDetailMap":'), F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("n"), "i")), F.array(note))), F.lit(',\n"seen":undefined}'), F.when(F.col("source_id") % 2 == 0, F.concat(F.lit(',"user":{"userPageData":{"basicInfo":'), F.to_json(F.struct(F.col("creator").alias("nickname"), F.lit("is undefined").alias("desc"))), F.lit("}}"))).otherwise(""), F.lit("}"))
    pages = _raw(spark, sf).select(F.col("source_id").alias("page_id"), _script(">window.__INITIAL_STATE__=", state).alias("html"))
    makers = search.page_creators(pages).select("page_id", F.lit("creator").alias("note_id"), F.col("nickname").alias("title"), F.col("description").alias("author"), F.lit(None).cast("long").alias("likes"))
    return search.page_notes(pages).select("page_id", "note_id", "title", "author", "likes").unionByName(makers)


@query(rf"with {v.SRC} select source_id as page_id, case when source_id % 2 = 0 then 'answers' else 'articles' end as kind, cast(source_id as varchar) as entity_id, coalesce({_STRIP.format('title')}, '') as title, coalesce({_STRIP.format('creator')}, '') as author from src union all select source_id, 'users', 'u1', coalesce({_STRIP.format('creator')}, ''), coalesce({_STRIP.format('creator')}, '') from src")
def page_entities(spark, sf):
    even = F.col("source_id") % 2 == 0
    answer = F.map_from_arrays(F.array("i"), F.array(F.struct(F.struct("title").alias("question"), F.struct(F.col("creator").alias("name")).alias("author"))))
    article = F.map_from_arrays(F.array("i"), F.array(F.struct("title", F.lit("u1").alias("author"))))
    users = F.map_from_arrays(F.array(F.lit("u1")), F.array(F.struct(F.col("creator").alias("name"))))
    entities = F.struct(F.when(even, answer).alias("answers"), F.when(~even, article).alias("articles"), users.alias("users"))
    body = F.to_json(F.struct(F.struct(entities.alias("entities")).alias("initialState")))
    pages = _raw(spark, sf).select(F.col("source_id").alias("page_id"), _script(' id="js-initialData" type="text/json">', body).alias("html"))
    return search.page_entities(pages).select("page_id", "kind", "entity_id", "title", "author")


@query(rf"with {v.SRC}, b as (select *, coalesce({_STRIP.format('title')}, '') as x from src) select source_id as page_id, cast(source_id as varchar) as note_id, {_PLAIN.format('x')} as text, coalesce({_STRIP.format('creator')}, '') as author, cast(source_id % 100 as bigint) as likes from b")
def detail_notes(spark, sf):
    status = F.struct(F.col("i").alias("id"), F.col("title").alias("text"), F.struct(F.col("creator").alias("screen_name")).alias("user"), (F.col("source_id") % 100).alias("attitudes_count"))
    body = F.to_json(F.array(F.struct(status.alias("status"))))
    pages = _raw(spark, sf).select(F.col("source_id").alias("page_id"), _script(">var $render_data = ", body, "[0] || {};</script></html>").alias("html"))
    return search.detail_notes(pages).select("page_id", "note_id", "text", "author", "likes")


# ---- model responses and plans ---------------------------------------------------------------------------------------


def _answers(spark, sf, payload):
    """A response for each source, with the ids that it may cite."""
    i = F.col("source_id")
    return v.src(spark, sf).select(i.alias("run_id"), payload.alias("payload"), F.array(i, i + 1, i + 2).alias("allowed"))


@query(rf"with {v.SRC}, b as (select source_id as run_id, coalesce({_STRIP.format('title')}, '') as x from src) select run_id, x as text, run_id || ',' || (run_id + 2) as citations, 1 as rank from b where x <> '' union all select run_id, 'second', '', case when x <> '' then 2 else 1 end from b")
def takeaways(spark, sf):
    i = F.col("source_id")
    first = F.to_json(F.struct(F.col("title").alias("text"), F.array(i, i + 9, i + 2, i).alias("citations")))
    payload = F.concat(F.lit('{"takeaways":['), first, F.lit(',{"text":" second ","sourceIds":[]},{"text":" "},"bare"]}'))
    return responses.takeaways(_answers(spark, sf, payload)).withColumn("citations", _ids("citations"))


@query(rf"with {v.SRC} select source_id as run_id, case when source_id % 2 = 0 then 'risk' else 'consensus' end as kind, 'L' || source_id as label, cast(least(5, greatest(1, source_id % 8)) as integer) as confidence, cast(source_id + 1 as varchar) as source_ids, 1 as rank from src")
def insights(spark, sf):
    i = F.col("source_id")
    item = F.struct(F.when(i % 2 == 0, "risk").otherwise("rumour").alias("kind"), F.concat(F.lit(" L"), i.cast("string")).alias("label"), (i % 8).cast("string").alias("confidence"), F.array(F.concat((i + 1).cast("string"))).alias("sourceIds"))
    rows = responses.insights(_answers(spark, sf, F.to_json(F.struct(F.array(item).alias("insights")))))
    return rows.select("run_id", "kind", "label", "confidence", _ids("source_ids").alias("source_ids"), "rank")


@query(rf"with {v.SRC}, b as (select source_id as run_id, coalesce({_STRIP.format('title')}, '') as x from src) select run_id, x as candidate, 'sound' as dimension, 'fine' as conclusion, run_id as source_id, 3 as confidence, 1 as rank from b")
def semantic_evidence(spark, sf):
    i = F.col("source_id")
    good = F.struct(F.col("title").alias("model"), F.lit("sound").alias("key"), F.lit("fine").alias("summary"), F.array(i).alias("sourceIds"))
    bad = F.struct(F.lit("x").alias("model"), F.lit("sound").alias("key"), F.lit("fine").alias("summary"), F.array(i + 7).alias("sourceIds"))
    rows = responses.semantic_evidence(_answers(spark, sf, F.to_json(F.struct(F.array(bad, good).alias("evidence")))))
    return rows.select("run_id", "candidate", "dimension", "conclusion", "source_id", "confidence", "rank")


@query(rf"with {v.SRC}, b as (select source_id as run_id, coalesce({_STRIP.format('title')}, '') as x from src) select run_id, substr(x, 1, 120) as name, 5 as support, 1 as risk, 3 as confidence, run_id || ',' || (run_id + 1) as evidence from b where x <> ''")
def table_rows(spark, sf):
    i = F.col("source_id")
    item = F.struct(F.col("title").alias("name"), F.lit(9).alias("support"), F.lit(-2).alias("risk"), F.array(i, i + 1).alias("evidence"))
    rows = responses.table_rows(_answers(spark, sf, F.to_json(F.struct(F.array(item).alias("table")))))
    return rows.select("run_id", "name", "support", "risk", "confidence", _ids("evidence").alias("evidence"))


@query(f"with {v.SRC} select source_id as run_id, 'P' || (source_id % 9) as product, 'sound' as dimension, 'C' || source_id as conclusion, cast(source_id as varchar) as source_ids from src")
def decision_products(spark, sf):
    i = F.col("source_id")
    cell = F.struct(F.concat(F.lit("C"), i.cast("string")).alias("conclusion"), F.array(i, i + 50).alias("sources"))
    payload = F.to_json(F.struct(F.map_from_arrays(F.array(F.concat(F.lit(" P"), (i % 9).cast("string"))), F.array(F.map_from_arrays(F.array(F.lit("sound")), F.array(F.array(cell))))).alias("products")))
    rows = responses.decision_products(_answers(spark, sf, payload))
    return rows.select("run_id", "product", "dimension", "conclusion", _ids("source_ids").alias("source_ids"))


@query(f"with {v.SRC} select source_id as run_id, 'price' as dimension, source_id % 3 = 0 as contradictory, 'R' || source_id as reason from src")
def contradiction_notes(spark, sf):
    i = F.col("source_id")
    item = F.struct((i % 3 == 0).alias("isContradictory"), F.concat(F.lit("R"), i.cast("string")).alias("possibleReason"))
    payload = F.to_json(F.struct(F.map_from_arrays(F.array(F.lit("price")), F.array(item)).alias("contradictions")))
    return responses.contradiction_notes(_answers(spark, sf, payload)).select("run_id", "dimension", "contradictory", "reason")


@query(f"with {v.SRC}, s as (select source_id, run_id from src), p as (select run_id, list(source_id order by source_id desc) as ids from s group by 1), e as (select run_id, unnest(ids[1:24]) as source_id, generate_subscripts(ids[1:24], 1) - 1 as position from p) select run_id, source_id, cast(position as integer) as position from e")
def selected_sources(spark, sf):
    """Each run's response lists all of its sources, in parts of a thousand ids' range."""
    s = v.src(spark, sf).select("run_id", "source_id")
    ids = F.sort_array(F.collect_list("source_id"), asc=False)
    part = (-F.floor(F.col("source_id") / 1000)).alias("part")
    answers = s.groupBy("run_id", part).agg(F.to_json(F.struct(ids.alias("selectedSourceIds"))).alias("payload"))
    return responses.selected_sources(answers, s)


@query(f"with {v.LOGS}, n as (select run_id, count(*) as calls, cast(sum(greatest(0, count - 1)) as bigint) as tokens from logs group by 1) select *, greatest(0, 10 - calls) as calls_left from n")
def token_use(spark, sf):
    return responses.token_use(v.logs(spark, sf).select("run_id", (F.col("count") - 1).alias("tokens")))


@query(rf"with {v.SRC} select run_id, source_id, substr(coalesce(title, ''), 1, 240) as title, sha256(substr(regexp_replace(coalesce(transcript, ''), '\s+', ' ', 'g'), 1, 4000)) as text_sha256, cast(least(8, ceil(least(12000, length(regexp_replace(coalesce(transcript, ''), '\s+', ' ', 'g'))) / 1600.0)) as integer) as chunks from src")
def prompt_packs(spark, sf):
    packs = responses.prompt_packs(v.src(spark, sf))
    get = lambda path: F.coalesce(F.get_json_object("payload", path), F.lit(""))
    chunks = F.size(F.from_json(F.get_json_object("payload", "$.transcriptChunks"), "array<string>"))
    return packs.select("run_id", "source_id", get("$.title").alias("title"), F.sha2(get("$.fullTranscript"), 256).alias("text_sha256"), chunks.alias("chunks"))


_QUESTION = "case item_id % 3 when 0 then 'iPhone 15 vs Xiaomi 14 review' when 1 then '2024 best headphone' else 'car problems complaint' end || ' ' || item_id"

@query(
    f"""with b as (select item_id, item_id % 3 as k from benchmark), p as (select item_id, k, unnest([{', '.join(repr(p) for p in k.PLATFORMS)}]) as platform from b)
select item_id, platform, 'primary' as role, case when platform = 'youtube' then 'opencli' else 'crawler' end as provider, case when platform = 'youtube' then 20 else 12 end as "limit", case when platform = 'youtube' then 6 else 2 end as detail_limit from p union all select item_id, platform, 'fallback', 'opencli', 12, 2 from p where platform = 'bilibili'"""
)
def query_plan(spark, sf):
    questions = v.table(spark, sf, "benchmark").select("item_id", F.expr(_QUESTION).alias("query"))
    rows = planner.with_fallbacks(planner.targets(planner.analyze(questions)))
    return rows.select("item_id", "platform", "role", "provider", "limit", "detail_limit")


@query("with b as (select item_id, item_id % 3 as k from benchmark) select item_id, case k when 0 then 'review,comparison' when 1 then 'recommendation' else 'complaint' end as intents, case when k = 1 then '2024' else '' end as time_range from b")
def query_analysis(spark, sf):
    questions = v.table(spark, sf, "benchmark").select("item_id", F.expr(_QUESTION).alias("query"))
    return planner.analyze(questions).select("item_id", F.array_join("intents", ",").alias("intents"), "time_range")
