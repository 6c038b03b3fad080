"""Queries over the adapter views: sources, texts, coverage, evidence, grounding, reports, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as cit
from ..functions import segment
from ..functions import text as t
from ..functions import urls
from ..operators import collect, coverage, decision, evidence, grounding, report
from ..operators.storage import written
from . import views as v

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def decorated(spark: SparkSession, sf: str, head: int | None = None) -> DataFrame:
    return collect.decorate_sources(v.src(spark, sf, head), v.QUERY_TERMS)


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.evidence_quality(decorated(spark, sf), "2010-01-01", "2026-12-31")


KEY = "platform || ':' || regexp_replace(split_part(lower(url), '?', 1), '/+$', '')"

# The seven dimensions for columns of `deco`, whose transcripts and creators are mostly there.
_QUALITY = f"""{v.DECORATED}, dims as (
  select *, case when relevance <> 0 then least(1.0, greatest(0.0, relevance / 100.0)) else 0.65 end as d1,
    case when coalesce(transcript, '') <> '' then 0.75 when n_comments > 0 then 0.45 else 0.25 end as d2, case when coalesce(url, '') <> '' then 0.4 else 0.15 end as d3,
    case when coalesce(transcript, '') <> '' then 0.6 else 0.5 end as d4,
    case when sponsored then 0.35 when verified then 0.85 when coalesce(creator, '') <> '' then 0.65 else 0.35 end as d5, 0.5 as d6,
    case when published = '' then 0.5 when published < '2010-01-01' then 0.2 when published > '2026-12-31' then 0.2 else 0.9 end as d7 from deco),
qual as (select *, (d1 + d2 + d3 + d4 + d5 + d6 + d7) / 7 as mean from dims),
assessed as (select *, case when d1 < 0.35 then 'Insufficient' when mean >= 0.78 and least(d2, d3) >= 0.6 then 'Strong' when mean >= 0.58 then 'Moderate' when mean >= 0.38 then 'Weak' else 'Insufficient' end as label from qual)"""


@query(f"with {v.SRC}, k as (select *, {KEY} as dedupe_key from src) select run_id, source_id, dedupe_key from k qualify row_number() over (partition by run_id, dedupe_key order by source_id) = 1")
def dedupe_sources(spark, sf):
    return collect.dedupe_sources(v.src(spark, sf).select("run_id", "source_id", "platform", "url", "title")).select("run_id", "source_id", "dedupe_key")


@query(
    f"""with {v.SRC}, b as (select run_id, source_id, case when source_id % 3 = 0 then 0 else 1 end as batch, {KEY} as k from src),
f as (select * from b qualify row_number() over (partition by run_id, k order by batch, source_id) = 1)
select run_id, source_id, row_number() over (partition by run_id order by batch, source_id) as position from f qualify position <= 50"""
)
def merge_batches(spark, sf):
    s = v.src(spark, sf).select("run_id", "source_id", "platform", "url", "title")
    return collect.merge_batches([s.where("source_id % 3 = 0"), s.where("source_id % 3 != 0")]).select("run_id", "source_id", "position")


@query(f"with {v.DECORATED} select source_id, evidence_score, n_matches, relevance, case when evidence_score < 5 then 'weak' else 'ranked' end as status, case when platform in ('bilibili', 'douyin', 'youtube') then 'video' when platform = 'xiaohongshu' then 'note' when platform = 'zhihu' then 'article' else 'content' end as source_type, 'example.com' as domain from deco")
def decorate_source(spark, sf):
    return decorated(spark, sf).select("source_id", "evidence_score", F.size("matches").alias("n_matches"), "relevance", "status", "source_type", "domain")


@query(f"with {v.SRC} select source_id, concat_ws(',', case when title <> '' then 'title' end, case when n_comments > 0 then 'comments' end, case when transcript <> '' then 'transcript' end, case when url <> '' then 'url' end) as channels from src")
def evidence_channels(spark, sf):
    return v.src(spark, sf).select("source_id", F.array_join(collect.channels(), ",").alias("channels"))


@query(f"with {_QUALITY} select run_id, source_id, label, row_number() over (partition by run_id order by case label when 'Strong' then 4 when 'Moderate' then 3 when 'Weak' then 2 else 1 end desc, relevance desc, (coalesce(transcript, '') <> '') desc, source_id) as display_id from assessed")
def rank_evidence(spark, sf):
    return collect.rank_evidence(assessed(spark, sf)).select("run_id", "source_id", "label", "display_id")


@query(f"with {v.DECORATED} select run_id, source_id, row_number() over (partition by run_id order by evidence_score desc, citation_count desc, source_id) as rank from deco qualify rank <= 8")
def top_sources(spark, sf):
    return collect.top_sources(decorated(spark, sf)).select("run_id", "source_id", "rank")


@query("with c as (select conv_id as source_id, text, row_number() over (partition by conv_id order by turn) as rank from conversations where role = 'user') select source_id, count(*) as n, string_agg(text, ' | ' order by rank) as comments from c where rank <= 3 group by 1")
def comments_top_n(spark, sf):
    return collect.first_comments(v.comments(spark, sf)).select("source_id", F.size("comments").cast("long").alias("n"), F.array_join("comments", " | ").alias("comments"))


@query(f"with {v.SRC} select run_id, platform, count(*) as n, count(*) filter (where citation_count > 0) as cited from src group by 1, 2")
def source_platform_facet(spark, sf):
    return collect.platform_facet(v.src(spark, sf))


@query(r"select page_id, sha256(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) as text_sha256 from pages")
def strip_html(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", F.sha2(t.strip_html("html"), 256).alias("text_sha256"))


_WORDS = r"unnest(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9+\-_.]*'))"
_STOP = ", ".join(f"'{w}'" for w in v.STOP)


@query(
    f"""with {v.SRC}, w as (select run_id, lower({_WORDS.format('title')}) as word from src), n as (select run_id, word, count(*) as n from w where length(word) > 1 and word not in ({_STOP}) group by 1, 2)
select run_id, word, n, row_number() over (partition by run_id order by n desc, word) as rank from n qualify rank <= 12"""
)
def keywords_top12(spark, sf):
    return report.keywords(v.src(spark, sf).select("run_id", F.col("title").alias("text")), stop_words=v.STOP)


_COUNTS = " union all ".join(f"select run_id, '{w}' as term, sum((length(x) - length(replace(x, '{w}', ''))) // {len(w)}) as n from x group by 1" for w in v.RISK)
_RISKS = f"{v.SRC}, x as (select run_id, lower(coalesce(title, '') || ' ' || summary || ' ' || coalesce(transcript, '')) as x from src), r as ({_COUNTS}), risks as (select run_id, term, n, row_number() over (partition by run_id order by n desc, term) as rank from r where n > 0 qualify rank <= 8)"


@query(f"with {_RISKS} select run_id, term, cast(n as bigint) as n, rank from risks")
def risk_terms(spark, sf):
    return report.risk_terms(v.src(spark, sf).select("run_id", F.concat_ws(" ", "title", "summary", "transcript").alias("text")), v.RISK)


@query(f"with {v.SRC}, x as (select source_id, list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9+._-]*'))) as t from src) select source_id, len(t) as n_terms, array_to_string(t, ' ') as terms from x")
def term_sets(spark, sf):
    found = F.array_sort(t.terms("title"))
    return v.src(spark, sf).select("source_id", F.size(found).cast("long").alias("n_terms"), F.array_join(found, " ").alias("terms"))


@query("select replace(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ''), 'www.', '') as host, count(*) as n from pages group by 1")
def url_hosts(spark, sf):
    return v.table(spark, sf, "pages").groupBy(urls.host("url").alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with p as (select *, {v._PLATFORM_SQL.format('page_id')} as platform, case page_id % 7 when 0 then 'https://www.bilibili.com/video/BV1x' || page_id || '?p=1' when 1 then 'https://www.douyin.com/video/' || page_id || '/' when 2 then 'https://www.youtube.com/watch?v=abcdef' || page_id
  when 3 then 'https://www.xiaohongshu.com/explore/n' || page_id when 4 then 'https://zhuanlan.zhihu.com/p/' || page_id when 5 then url else 'https://weibo.com/u/' || page_id end as u from pages)
select page_id, case page_id % 7 when 3 then 'note' when 4 then 'article' when 5 then 'unknown' when 6 then 'creator' else 'video' end as kind,
  case page_id % 7 when 0 then 'BV1x' || page_id when 2 then 'abcdef' || page_id when 3 then 'n' || page_id when 5 then '' else cast(page_id as varchar) end as object_id from p"""
)
def url_object_ids(spark, sf):
    p = v.table(spark, sf, "pages").withColumn("platform", v._platform("page_id"))
    i = F.col("page_id").cast("string")
    made = F.coalesce(*(F.when(F.col("page_id") % 7 == n, F.concat(F.lit(a), i, F.lit(b))) for n, a, b in ((0, "https://www.bilibili.com/video/BV1x", "?p=1"), (1, "https://www.douyin.com/video/", "/"), (2, "https://www.youtube.com/watch?v=abcdef", ""), (3, "https://www.xiaohongshu.com/explore/n", ""), (4, "https://zhuanlan.zhihu.com/p/", ""), (6, "https://weibo.com/u/", ""))), F.col("url"))
    found = p.withColumn("o", urls.object_of("platform", made))
    return found.select("page_id", "o.kind", F.col("o.id").alias("object_id"))


@query(
    rf"with {v.SRC} select source_id, substr(regexp_replace(concat_ws(' ', nullif(regexp_replace(title, '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(transcript, '^\s+|\s+$', '', 'g'), '')), '\s+', ' ', 'g'), 1, 220) as excerpt from src"
)
def text_excerpts(spark, sf):
    return v.src(spark, sf).select("source_id", t.excerpt(["title", "transcript"]).alias("excerpt"))


@query(f"with w as (select lower({_WORDS.format('text')}) as word from conversations where role = 'user') select word, count(*) as n from w where length(word) > 1 and word not in ({_STOP}) group by 1 order by n desc, word limit 20")
def word_frequency(spark, sf):
    return report.word_frequency(v.comments(spark, sf), stop_words=v.STOP)


# Latin letters as Chinese characters make runs of them from the tables' words; the benchmark's groups are the lexicon.
_LETTERS, _CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这为之大来以个中上们到说国和地也"
_CUSTOM = {"之们": 40, "大在之": 30}
_RUNS = f"unnest(regexp_extract_all(translate(lower(text), '{_LETTERS}', '{_CHARACTERS}'), '[一-鿿]+'))"
_SCORE = "cast(round(1000000 * (ln(freq) - ln(total))) as bigint)"
_CUSTOM_ROWS = ", ".join(f"('{w}', {f})" for w, f in _CUSTOM.items())
_PATHS = f"""lr as (select {_RUNS} as run from benchmark), lw as (select substr(run, i, l) as word from lr, unnest(range(1, length(run) + 1)) a(i), unnest(range(1, 5)) b(l) where i + l <= length(run) + 1),
own as (select * from (values {_CUSTOM_ROWS}) t(word, freq)), counted as (select word, count(*) as freq from lw group by 1 having count(*) >= 3),
tot as (select sum(freq) + (select sum(freq) from own) as total from counted),
lex as materialized (select word, {_SCORE} as s from (select * from own union all select * from counted where word not in (select word from own)), tot),
unk as (select cast(round(-1000000 * ln(total)) as bigint) as u from tot), runs as materialized (select run, count(*) as n from (select {_RUNS} as run from conversations where role = 'user') group by 1),
steps as materialized (select run, i, list({{'l': l, 's': coalesce(s, u)}}) as ways from (select run, i, l, substr(run, i, l) as word from runs, unnest(range(1, length(run) + 1)) a(i), unnest(range(1, 5)) b(l) where i + l <= length(run) + 1) g cross join unk left join lex using (word) where s is not null or l = 1 group by 1, 2),
back as (select run, length(run) + 1 as i, [cast(0 as bigint)] as best, cast([] as bigint[]) as lens from runs union all
  select run, i, list_prepend(top.s, best), list_prepend(top.l, lens) from (select b.run, s.i, best, lens, list_sort([{{'s': w.s + best[w.l], 'l': w.l}} for w in ways])[-1] as top from back b join steps s on s.run = b.run and s.i = b.i - 1)),
cuts as (select run, 1 as i, lens, cast([] as varchar[]) as words from back where i = 1 union all
  select run, i + lens[i], lens, list_append(words, substr(run, i, lens[i])) from cuts where i <= len(lens)),
paths as materialized (select run, n, words from cuts join runs using (run) where i > len(lens))"""


def _chinese(spark, sf):
    made = F.translate(F.lower("text"), _LETTERS, _CHARACTERS)
    said = v.table(spark, sf, "conversations").where("role = 'user'").select(made.alias("text"))
    return said, segment.lexicon_of(v.table(spark, sf, "benchmark").select(made.alias("text")), min_count=3)


@query(f"with recursive {_PATHS} select run, n, array_to_string(words, '/') as words from paths")
def segmented_runs(spark, sf):
    said, lexicon = _chinese(spark, sf)
    return segment.segmented(segment.runs(said), lexicon, _CUSTOM).withColumn("words", F.array_join("words", "/"))


@query(f"with recursive {_PATHS} select word, cast(sum(n) as bigint) as n from (select unnest(words) as word, n from paths) where word not in ('的', '了') group by 1 order by n desc, word limit 30")
def chinese_word_frequency(spark, sf):
    said, lexicon = _chinese(spark, sf)
    only = said.withColumn("text", F.regexp_replace("text", r"[^一-鿿]+", " "))
    return report.word_frequency(only, 30, ("的", "了"), lexicon=lexicon, custom=_CUSTOM)


_COVER = f"""{v.SRC}, {v.LOGS}, cover as (select run_id, count(*) as sources, sum(n_comments) as comments, count(distinct platform) as platforms, count(*) filter (where citation_count > 0) as cited,
  count(*) filter (where n_comments > 0) as with_comments, count(*) filter (where coalesce(transcript, '') <> '') as with_transcripts from src group by 1),
lr as (select run_id, count(*) as provider_runs, count(*) filter (where ok) as runs_ok, count(*) filter (where not ok) as runs_failed from logs group by 1),
summary as (select cover.*, coalesce(provider_runs, 0) as provider_runs, coalesce(runs_ok, 0) as runs_ok, coalesce(runs_failed, 0) as runs_failed from cover left join lr using (run_id)),
conf as (select *, sources * 8 + platforms * 12 + least(30, comments) + with_transcripts * 8 + runs_ok * 4 as score from summary)"""
_CONFIDENCE = "case when score >= 95 then 'high' when score >= 55 then 'medium' when score >= 20 then 'low' else 'insufficient' end"


def _summary(spark, sf):
    return coverage.coverage_summary(v.src(spark, sf), v.logs(spark, sf))


@query(f"with {_COVER} select run_id, sources, cast(comments as bigint) as comments, platforms, cited, with_comments, with_transcripts, provider_runs, runs_ok, runs_failed from summary")
def coverage_summary(spark, sf):
    return _summary(spark, sf)


@query(f"with {_COVER} select run_id, cast(score as bigint) as score, {_CONFIDENCE} as confidence from conf")
def run_confidence(spark, sf):
    return coverage.run_confidence(_summary(spark, sf)).select("run_id", "score", "confidence")


@query(
    f"""with {v.SRC}, {v.LOGS}, runs as (select distinct run_id from src), cat as (select run_id, unnest([{', '.join(repr(p) for p in v.PLATFORMS)}]) as platform from runs),
n as (select run_id, platform, count(*) as n from src group by 1, 2), l as (select run_id, platform, bool_and(not ok) as all_failed, substr(string_agg(note, '; ' order by seq) filter (where note <> ''), 1, 180) as note from logs group by 1, 2)
select cat.run_id, cat.platform, coalesce(n, 0) as n, case when coalesce(n, 0) > 0 then 'ok' when coalesce(all_failed, false) then 'failed' else 'partial' end as status, coalesce(note, '') as note
from cat left join n on n.run_id = cat.run_id and n.platform = cat.platform left join l on l.run_id = cat.run_id and l.platform = cat.platform"""
)
def platform_summaries(spark, sf):
    s = v.src(spark, sf)
    return report.platform_summaries(s, v.logs(spark, sf), s)


@query(
    f"""with {_COVER}, w as (select run_id, sources, concat_ws(',', case when sources = 0 then 'no_sources' end, case when runs_failed > 0 then 'providers_failed' end, case when sources > 0 and platforms = 1 then 'one_platform' end,
  case when sources > 0 and with_comments = 0 and with_transcripts = 0 then 'metadata_only' end) as warnings from summary) select run_id, warnings, case when sources = 0 then 'failed' when warnings <> '' then 'partial' else 'completed' end as status from w"""
)
def run_warnings(spark, sf):
    return report.run_warnings(_summary(spark, sf)).withColumn("warnings", F.array_join("warnings", ","))


@query(f"with {v.SRC}, c as (select run_id, unnest([case when title <> '' then 'title' end, case when n_comments > 0 then 'comments' end, case when transcript <> '' then 'transcript' end, case when url <> '' then 'url' end]) as channel from src) select run_id, channel, count(*) as n from c where channel is not null group by 1, 2")
def channel_counts(spark, sf):
    return report.channel_counts(v.src(spark, sf).select("run_id", collect.channels().alias("channels")))


def _any(column, words):
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_SIGNALS = ("the", "best", "zzz", "und")


@query(
    f"""with {v.SRC}, terms as (select distinct run_id, unnest([{', '.join(repr(x) for x in _SIGNALS)}]) as term from src),
x as (select *, lower(coalesce(title, '') || ' ' || summary || ' ' || substr(coalesce(transcript, ''), 1, 420)) as hay, lower(coalesce(title, '') || ' ' || coalesce(transcript, '')) as txt from src),
h as (select x.*, term, row_number() over (partition by x.run_id, term order by source_id) as nth from x join terms on terms.run_id = x.run_id and contains(hay, term))
select run_id, term, count(*) as n, cast(least(5, 2 + count(*) filter (where {_any('txt', v.POSITIVE)})) as integer) as support, cast(least(5, 2 + count(*) filter (where {_any('txt', v.RISK)})) as integer) as risk,
  cast(least(5, 1 + least(4, count(*)) + case when count(*) filter (where n_comments > 0) > 0 then 1 else 0 end) as integer) as confidence, count(*) filter (where n_comments > 0) as comment_sources,
  count(*) filter (where coalesce(transcript, '') <> '') as transcript_sources, array_to_string(list_sort(list(distinct platform)), ',') as platforms, string_agg(case when nth <= 4 then cast(source_id as varchar) end, ',' order by nth) as evidence from h group by 1, 2"""
)
def signal_rows(spark, sf):
    s = v.src(spark, sf).withColumn("text", F.concat_ws(" ", "title", "transcript"))
    terms = s.select("run_id").distinct().select("run_id", F.explode(t.words(_SIGNALS)).alias("term"))
    rows = report.signal_rows(s, terms, v.POSITIVE, v.RISK)
    return rows.withColumn("platforms", F.array_join("platforms", ",")).withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query(
    f"""with {_RISKS}, c as (select * from risks where rank <= 4), h as (select c.run_id, c.term, s.source_id, row_number() over (partition by c.run_id, c.term order by s.source_id) as nth from c join src s on s.run_id = c.run_id and contains(lower(coalesce(s.title, '') || ' ' || s.summary), c.term)),
o as (select run_id, term, string_agg(cast(source_id as varchar), ',' order by source_id) as own from h where nth <= 3 group by 1, 2),
f as (select run_id, string_agg(cast(source_id as varchar), ',' order by source_id) as first from (select run_id, source_id from src qualify row_number() over (partition by run_id order by source_id) <= 2) group by 1)
select c.run_id, c.term, c.rank, coalesce(own, first) as citations from c left join o on o.run_id = c.run_id and o.term = c.term left join f on f.run_id = c.run_id"""
)
def risk_bullets(spark, sf):
    s = v.src(spark, sf)
    risks = report.risk_terms(s.select("run_id", F.concat_ws(" ", "title", "summary", "transcript").alias("text")), v.RISK)
    return report.risk_bullets(s, risks).withColumn("citations", F.array_join(F.transform("citations", lambda x: x.cast("string")), ","))


@query(f"with {_QUALITY} select source_id, round(mean, 4) as mean, label, case when d5 >= 0.8 then 'strong' when d5 >= 0.6 then 'moderate' when d5 >= 0.35 then 'weak' else 'insufficient' end as credibility, case when d7 >= 0.8 then 'strong' when d7 >= 0.6 then 'moderate' when d7 >= 0.35 then 'weak' else 'insufficient' end as freshness from assessed")
def evidence_quality(spark, sf):
    return assessed(spark, sf).select("source_id", F.round("mean", 4).alias("mean"), "label", "dimensions.credibility", "dimensions.freshness")


@query(f"""with {v.SRC} select source_id, sha256('{{"platform":"' || platform || '","source_id":' || source_id || ',"url":"' || url || '"}}') as content_hash, 'artifact-' || source_id || '-' || substr(sha256('{{"platform":"' || platform || '","source_id":' || source_id || ',"url":"' || url || '"}}'), 1, 12) as artifact_id from src""")
def artifact_hashes(spark, sf):
    return evidence.artifacts(v.src(spark, sf), ["url", "source_id", "platform"]).select("source_id", "content_hash", "artifact_id")


_CLEAN = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(
    f"""with u as (select conv_id as source_id, turn * 10000 as start_ms, turn * 10000 + 9000 as end_ms, ((conv_id + turn) % 10) / 10.0 as conf, {_CLEAN} as clean from conversations)
select source_id, start_ms, end_ms, 'unit-' || substr(sha256(source_id || '|' || start_ms || '|' || end_ms || '|' || clean), 1, 16) as unit_id, sha256(clean) as content_hash, case when conf < 0.65 then 'low_confidence' else 'unreviewed' end as review_status from u where clean <> ''"""
)
def transcript_units(spark, sf):
    return evidence.transcript_units(v.segments(spark, sf)).drop("asr_confidence")


_CHUNKS = "with c as (select doc_id as source_id, text, unnest(range(least(8, cast(ceil(least(12000, length(text)) / 1600.0) as bigint)))) as chunk from documents where text is not null) select source_id, cast(chunk as integer) as chunk, sha256(substr(substr(text, 1, 12000), cast(chunk as bigint) * 1600 + 1, 1600)) as text_sha256 from c"


@query(_CHUNKS)
def transcript_chunks(spark, sf):
    return evidence.transcript_chunks(v.src(spark, sf)).select("source_id", "chunk", F.sha2("text", 256).alias("text_sha256"))


@query(_CHUNKS)
def chunk_function(spark, sf):
    """The same chunks by the table function in SQL."""
    evidence.register_chunks(spark)
    texts = v.src(spark, sf).select("source_id", "transcript")
    return spark.sql("select s.source_id, c.chunk, sha2(c.text, 256) as text_sha256 from {texts} s, lateral transcript_chunks(s.transcript) c", texts=texts)


def _citations(spark, sf):
    """A citation for each turn: a moment, a comment, a frame, a whole source or a broken one."""
    seg = v.segments(spark, sf)
    i, p = F.col("source_id"), F.col("pos")
    head = F.concat(F.lit("["), F.upper(v._platform("source_id")), F.lit(":"), i.cast("string"))
    clock = lambda s: F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), (s % 60).cast("int"))
    kind = F.pmod(i + p, F.lit(5))
    text = (
        F.when(kind == 0, F.concat(head, F.lit("@"), clock(p * 10 + 5), F.lit("-"), clock(p * 10 + 15), F.lit("]")))
        .when(kind == 1, F.concat(head, F.lit("/comment/c"), p.cast("string"), F.lit("]")))
        .when(kind == 2, F.concat(head, F.lit("/frame/"), p.cast("string"), F.lit("/ocr]")))
        .when(kind == 3, F.concat(head, F.lit("]")))
        .otherwise(F.concat(head, F.lit("@9-8]")))
    )
    return seg.select((i * 1000 + p).alias("citation_id"), "source_id", "pos", text.alias("citation")).withColumn("cited", cit.parse_citation("citation"))


_CITED = f"cited as (select conv_id * 1000 + turn as citation_id, conv_id as source_id, turn as pos, (conv_id + turn) % 5 as kind, {v._PLATFORM_SQL.format('conv_id')} as platform from conversations)"


@query(f"with {_CITED} select citation_id, case kind when 0 then 'timestamp' when 1 then 'comment' when 2 then 'frame' when 3 then 'source' else 'invalid' end as kind, case when kind < 4 then upper(platform) else '' end as platform, case when kind = 0 then (pos * 10 + 5) * 1000 end as start_ms, case when kind = 0 then (pos * 10 + 15) * 1000 end as end_ms, case when kind = 1 then 'c' || pos else '' end as comment_id, case when kind = 2 then cast(pos as integer) end as frame_index from {'cited'}")
def citation_parse(spark, sf):
    return _citations(spark, sf).select("citation_id", "cited.kind", "cited.platform", "cited.start_ms", "cited.end_ms", "cited.comment_id", "cited.frame_index")


@query(
    f"""with {_CITED}, u as (select conv_id as source_id, turn as pos, turn * 10000 as s, turn * 10000 + 9000 as e from conversations),
m as (select citation_id, u.source_id * 1000 + u.pos as unit_id, row_number() over (partition by citation_id order by case when kind = 0 then abs(u.s - (cited.pos * 10 + 5) * 1000) else 0 end, u.pos) as rn from cited join u on u.source_id = cited.source_id
  and case kind when 0 then u.s <= (cited.pos * 10 + 15) * 1000 and u.e >= (cited.pos * 10 + 5) * 1000 when 1 then u.pos = cited.pos when 2 then u.pos = cited.pos when 3 then true else false end)
select citation_id, unit_id from cited left join m using (citation_id) where coalesce(rn, 1) = 1"""
)
def citation_resolve(spark, sf):
    u = v.segments(spark, sf).select("source_id", "pos", (F.col("source_id") * 1000 + F.col("pos")).alias("unit_id"), "start_ms", "end_ms", F.concat(F.lit("c"), F.col("pos").cast("string")).alias("comment_id"), F.col("pos").cast("int").alias("frame_index"))
    return grounding.resolve_citations(_citations(spark, sf), u)


@query(
    f"""with {_CITED} select citation_id, case when kind = 4 then '' when platform = 'bilibili' then 'https://www.bilibili.com/video/' || source_id || case when kind = 0 then '?t=' || (pos * 10 + 5) else '' end
  when platform = 'douyin' then 'https://www.douyin.com/video/' || source_id || case when kind = 1 then '?comment_id=c' || pos else '' end when platform = 'youtube' then 'https://www.youtube.com/watch?v=' || source_id || case when kind = 0 then '&t=' || (pos * 10 + 5) || 's' else '' end
  when platform = 'xiaohongshu' then 'https://www.xiaohongshu.com/explore/' || source_id else '' end as link from cited"""
)
def citation_links(spark, sf):
    return _citations(spark, sf).select("citation_id", cit.link("cited").alias("link"))


def _claims(spark, sf):
    return v.table(spark, sf, "benchmark").select((F.col("item_id") % 10).alias("run_id"), F.col("item_id").alias("claim_id"), F.concat_ws(" ", "text", F.expr(_ZH_CLAIM)).alias("claim_text"))


def _units(spark, sf):
    return v.table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("run_id"), F.col("doc_id").alias("unit_id"), F.concat_ws(" ", "text", F.expr(_ZH_UNIT)).alias("text"))


# Some claims and units have Chinese words, so that pairs, single characters and Chinese negations are met.
_ZH_CLAIM = "case item_id % 3 when 0 then '降噪不好' when 1 then '音质好 x 强' else '' end"
_ZH_UNIT = "case doc_id % 4 when 0 then '降噪很好' when 1 then '音质好，强' else '' end"
_TERMS = "list_distinct(list_concat(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9+._-]*'), flatten(list_transform(regexp_extract_all(lower({0}), '[一-鿿]+'), lambda r: case when length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end))))"
_NEG = _any("lower({0})", ("不", "没有", "并非", "不是", "无", "not", "no", "never", "without", "false"))
_PAIRS = f"""ctext as (select item_id % 10 as run_id, item_id as claim_id, concat_ws(' ', text, {_ZH_CLAIM}) as x from benchmark), utext as (select doc_id % 10 as run_id, doc_id as unit_id, concat_ws(' ', text, {_ZH_UNIT}) as x from documents),
c as (select run_id, claim_id, {_TERMS.format('x')} as t, {_NEG.replace('{0}', 'x')} as neg from ctext), u as (select run_id, unit_id, {_TERMS.format('x')} as t, {_NEG.replace('{0}', 'x')} as neg from utext),
ct as (select run_id, claim_id, len(t) as n, unnest(t) as term from c), ut as (select run_id, unit_id, unnest(t) as term from u),
sh as (select claim_id, unit_id, max(n) as n, count(*) as shared from ct join ut using (run_id, term) group by 1, 2),
pairs as (select sh.claim_id, sh.unit_id, shared, shared / cast(n as double) as overlap, c.neg = u.neg as agrees from sh join c using (claim_id) join u using (unit_id) where shared / cast(n as double) >= 0.3)"""


def _pairs(spark, sf):
    return grounding.claim_overlap(_claims(spark, sf), _units(spark, sf), by=("run_id",))


@query(f"with {_PAIRS} select claim_id, unit_id, shared, round(overlap, 4) as overlap, agrees from pairs")
def claim_overlap(spark, sf):
    return _pairs(spark, sf).select("claim_id", "unit_id", F.col("shared").cast("long").alias("shared"), F.round("overlap", 4).alias("overlap"), "agrees")


_VERDICT = f"""{_PAIRS}, g as (select item_id as claim_id, coalesce(s, 0) as s, coalesce(x, 0) as x, coalesce(m, 0) as m from benchmark left join (select claim_id, count(*) filter (where agrees) as s, count(*) filter (where not agrees) as x, max(overlap) as m from pairs group by 1) p on p.claim_id = item_id),
verdict as (select claim_id, case when x > 0 then 'contradict' when s > 0 then 'support' else 'insufficient' end as relation, s as n_support, x as n_contradict,
  round(case when s > 0 and x > 0 then least(0.9, 0.55 + 0.08 * (s + x)) when x > 0 then least(0.95, 0.62 + 0.08 * x + 0.15 * m) when s > 0 then least(0.95, 0.58 + 0.08 * s + 0.2 * m) else greatest(0.05, least(0.45, m)) end, 3) as confidence from g)"""


@query(f"with {_VERDICT} select *, relation = 'insufficient' or (n_support > 0 and n_contradict > 0) or confidence < 0.65 as needs_review from verdict")
def claim_verdicts(spark, sf):
    return grounding.verdicts(_claims(spark, sf), _pairs(spark, sf))


@query(f"with {_VERDICT} select claim_id % 10 as run_id, count(*) filter (where relation = 'support') as support, count(*) filter (where relation = 'contradict') as contradict, count(*) filter (where relation = 'insufficient') as insufficient from verdict group by 1")
def relation_counts(spark, sf):
    judged = grounding.verdicts(_claims(spark, sf), _pairs(spark, sf))
    return grounding.relation_counts(judged.withColumn("run_id", F.col("claim_id") % 10), ["run_id"])


@query(
    rf"""with {v.SRC}, c as (select run_id, source_id as pos, regexp_replace(regexp_replace(title, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as claim_text from src), f as (select * from c where claim_text <> '' qualify row_number() over (partition by run_id, lower(claim_text) order by pos) = 1)
select run_id, pos, claim_text, row_number() over (partition by run_id order by pos) as rank from f qualify rank <= 12"""
)
def claims_dedupe(spark, sf):
    return grounding.dedupe_claims(v.src(spark, sf).select("run_id", F.col("source_id").alias("pos"), F.col("title").alias("claim_text")))


_COUNTER = ("pathetic", "worthless")
_GATE = f"""{v.SRC}, x as (select *, lower(concat_ws(' ', nullif(trim(coalesce(title, '')), ''), nullif(trim(coalesce(transcript, '')), ''))) as txt from src),
g as (select run_id, list_sort(list(distinct platform)) as covered, bool_or(contains(txt, 'the')) as e1, bool_or(contains(txt, 'pathetic')) as e2, bool_or(contains(txt, 'zebra crossing')) as e3, count(*) filter (where {_any('txt', _COUNTER)}) as counter_sources,
  bool_or(n_comments > 0) as has_comment from x group by 1)"""


def _gate(spark, sf):
    return coverage.coverage_gate(v.src(spark, sf).withColumn("comment_text", F.lit("")), v.plans(spark, sf), _COUNTER)


@query(
    f"""with {_GATE} select run_id, array_to_string(covered, ',') as platforms_covered, concat_ws(',', case when e1 then 'The' end, case when e2 then 'Pathetic' end, case when e3 then 'zebra crossing' end) as entities_covered,
  concat_ws(',', case when not list_contains(covered, 'bilibili') then 'bilibili' end, case when not list_contains(covered, 'youtube') then 'youtube' end, 'tiktok') as missing_platforms, counter_sources, counter_sources > 0 as counter_found, false as sufficient from g"""
)
def coverage_gate(spark, sf):
    g = _gate(spark, sf)
    return g.select("run_id", *(F.array_join(c, ",").alias(c) for c in ("platforms_covered", "entities_covered", "missing_platforms")), "counter_sources", "counter_found", "sufficient")


@query(
    f"""with {_GATE} select run_id, concat_ws(',', case when not list_contains(covered, 'bilibili') then 'platform:bilibili' end, case when not list_contains(covered, 'youtube') then 'platform:youtube' end, 'platform:tiktok', case when not e1 then 'entity:The' end, case when not e2 then 'entity:Pathetic' end,
  case when not e3 then 'entity:zebra crossing' end, 'evidence_intent:ocr', case when counter_sources = 0 then 'counterevidence' end) as gaps from g"""
)
def coverage_gaps(spark, sf):
    return coverage.coverage_gaps(_gate(spark, sf)).withColumn("gaps", F.array_join("gaps", ","))


@query(f"with {v.LOGS}, u as (select run_id, count(*) filter (where ok) as a, sum(count) as b from logs group by 1) select run_id, round(least(greatest(0.0, (50 - a % 50) / 50.0), greatest(0.0, (30 - b % 20) / 30.0), (10 - run_id % 4) / 10.0, (50000 - run_id * 100) / 50000.0, (300 - a % 100) / 300.0), 4) as remaining from u")
def budget_remaining(spark, sf):
    used = v.logs(spark, sf).groupBy("run_id").agg(F.count_if("ok").alias("a"), F.sum("count").alias("b"))
    used = used.select("run_id", (F.col("a") % 50).alias("sources"), (F.col("b") % 20).alias("asr_minutes"), (F.col("run_id") % 4).alias("llm_calls"), (F.col("run_id") * 100).alias("llm_tokens"), (F.col("a") % 100).alias("seconds"))
    return coverage.budget_remaining(used).select("run_id", "remaining")


@query(f"with {_QUALITY}, {v.LOGS}, s as (select run_id, count(*) as n, count(distinct platform) as p, count(*) filter (where label in ('Strong', 'Moderate')) as good, count(*) filter (where label <> 'Insufficient') as usable from assessed group by 1), l as (select run_id, count(*) filter (where ok and count > 0) as okr from logs group by 1) select run_id, coalesce(n, 0) as n, case when coalesce(n, 0) >= 50 then false else coalesce(n, 0) < 3 or coalesce(p, 0) < 2 or coalesce(good, 0) < 2 end as keep_searching, coalesce(n, 0) = 0 or (coalesce(usable, 0) = 0 and coalesce(okr, 0) = 0) as stop_insufficient from s full join l using (run_id)")
def stop_policy(spark, sf):
    return coverage.stop_policy(assessed(spark, sf), v.logs(spark, sf))


@query(
    f"""with {v.LOGS.replace('user_id % 10 as run_id', 'user_id as run_id')}, p as (select run_id, unnest([{', '.join(repr(p) for p in v.PLATFORMS)}]) as platform from (select distinct run_id from logs)),
l as (select run_id, platform, count(*) as runs, count(*) filter (where ok and count > 0) as good, arg_max(note, seq) as note from logs group by 1, 2)
select p.run_id, p.platform, coalesce(runs, 0) as runs, case when runs is null then true when runs >= 2 or good > 0 then false else not contains(note, 'permission denied') end as retry from p left join l on l.run_id = p.run_id and l.platform = p.platform"""
)
def platform_retry(spark, sf):
    logs = v.logs(spark, sf, by_user=True)
    planned = logs.select("run_id").distinct().select("run_id", F.explode(t.words(v.PLATFORMS)).alias("platform"))
    return coverage.platform_retry(planned, logs)


@query(f"with {v.SRC}, p as (select run_id, platform, count(*) as n from src where n_comments > 0 group by 1, 2) select run_id, source_id from src where n_comments = 0 and not exists (select 1 from p where p.run_id = src.run_id and p.platform = src.platform and p.n >= 6)")
def fallback_gate(spark, sf):
    s = v.src(spark, sf)
    return coverage.fallback_rows(s.where("n_comments > 0"), s.where("n_comments = 0"), 12).select("run_id", "source_id")


_ZH = "case source_id % 4 when 0 then '降噪很好，音质清晰' when 1 then '佩戴舒适 音质一般' when 2 then '音质优秀。降噪弱' else '续航' end"


def _text():
    """The text that decisions are mined from: title, up to 6,000 characters of the transcript as in the surveyed feature, and
    a Chinese remark."""
    return F.concat_ws(" ", "title", F.substring("transcript", 1, 6000), F.expr(_ZH)).alias("text")


def _scored_texts(spark, sf):
    """Sources with that text and their evidence score."""
    return decorated(spark, sf, 6000).withColumn("text", _text())


def _texts(spark, sf):
    """run_id, source_id and that text of the same sources, straight from the documents."""
    return v.texts(spark, sf).select("run_id", "source_id", _text())


_TEXTS = f"{v.DECORATED}, x as (select *, concat_ws(' ', title, substr(transcript, 1, 6000), {_ZH}) as txt from deco)"


@query()
def candidates(spark, sf):
    s = _scored_texts(spark, sf)
    return decision.candidates(s, decision.candidate_mentions(s))


def _named(spark, sf):
    """A table of mentions that needs no cleaning: the first Latin word of each title."""
    name = F.regexp_extract("title", "[A-Za-z]+", 0)
    return v.src(spark, sf).select("run_id", "source_id", name.alias("name"), F.lower(name).alias("key")).where("name != ''")


_OCC = "greatest(len(lower(txt)) - len(replace(lower(txt), {0}, ''))) // len({0}), (len(replace(lower(txt), ' ', '')) - len(replace(replace(lower(txt), ' ', ''), replace({0}, ' ', ''), ''))) // greatest(1, len(replace({0}, ' ', ''))))".replace("greatest(len(lower", "greatest((len(lower")
_CHOSEN = f"""{_TEXTS}, named as (select run_id, source_id, regexp_extract(title, '[A-Za-z]+') as name, lower(regexp_extract(title, '[A-Za-z]+')) as key from src where regexp_extract(title, '[A-Za-z]+') <> ''),
cs as (select m.run_id, m.key, m.name, m.source_id, greatest(1, {_OCC.format('m.key')}) + greatest(1, evidence_score // 20) as s from named m join x using (run_id, source_id)),
ca as (select run_id, key, arg_min(name, source_id) as name, count(distinct source_id) as n_sources, cast(sum(s) as bigint) as score from cs group by 1, 2),
chosen as (select *, row_number() over (partition by run_id order by n_sources desc, score desc, name desc) as rank from ca qualify rank <= 5)"""


@query(f"with {_CHOSEN} select run_id, key, name, n_sources, score, rank from chosen")
def candidate_scores(spark, sf):
    return decision.candidates(_scored_texts(spark, sf), _named(spark, sf))


_NEED = "the und sound of the day 降噪"
_DECISION_STOP = ", ".join("'" + w + "'" for w in sorted({*decision.k.DECISION_STOP_WORDS, *decision.k.DECISION_POSITIVE_WORDS, *decision.k.DECISION_NEGATIVE_WORDS}))
_COMPACT = r"regexp_replace(term, '[\s_\-]+', '', 'g')"
_DIMS = rf"""{_CHOSEN}, w as (select *, regexp_extract_all(lower(txt), '[a-z][a-z0-9+\-]*') as ws, regexp_extract_all(txt, '[一-鿿]{{2,}}') as rs from x),
d as (select distinct run_id, source_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), flatten(list_transform(rs, lambda r: list_transform(range(1, len(r)), lambda i: substr(r, i, 2)))), flatten(list_transform(rs, lambda r: list_transform(range(1, len(r) - 1), lambda i: substr(r, i, 3)))))) as term from w),
n as (select run_id, term, count(*) as n_sources from d where length(term) >= 2 and term not in ({_DECISION_STOP}) and not regexp_matches(term, '^\d+[a-z]*$') and not regexp_matches(term, '({decision.TAIL_WORDS})$') group by 1, 2 having count(*) >= 2),
kept as (select * from n where not exists (select 1 from chosen c where c.run_id = n.run_id and (contains(c.key, term) or contains(term, c.key) or contains(c.key, {_COMPACT}) or contains({_COMPACT}, c.key)))),
nth as (select run_id, min(n_sources) as least from (select run_id, n_sources from kept qualify row_number() over (partition by run_id order by n_sources desc) <= 6) group by 1),
near as (select kept.* from kept join nth using (run_id) where n_sources >= least - 1), oc as (select near.run_id, term, sum({_OCC.format('term')}) as occ from near join x using (run_id) group by 1, 2),
sd as (select run_id, term, n_sources, cast(n_sources * 20 + least(occ, 12) + case when contains('{_NEED}', term) then 12 else 0 end as bigint) as score from near join oc using (run_id, term)),
dims as (select *, row_number() over (partition by run_id order by score desc, length(term) desc, term) as rank from sd qualify rank <= 6)"""


def _dimensions(spark, sf):
    # Candidates and dimensions are a few rows a run that several steps ask for: both are made once, and Spark knows that
    # they are small.
    s = _texts(spark, sf)
    chosen = written(decision.candidates(_scored_texts(spark, sf), _named(spark, sf)))
    return s, chosen, written(decision.dimensions(s, chosen, _NEED))


@query(f"with {_DIMS} select run_id, term, n_sources, score, rank from dims")
def dimensions(spark, sf):
    return _dimensions(spark, sf)[2].select("run_id", "term", "n_sources", F.col("score").cast("long").alias("score"), "rank")


_HOLDS = _any("lower(sn)", v.POSITIVE), _any("lower(sn)", v.RISK)
_CONFLICTS = rf"""{_DIMS}, ss as (select run_id, source_id, lower(txt) as low, string_split_regex(regexp_replace(txt, '([。！？.!?])\s*', '\1' || chr(10), 'g'), '[\n\r]+') as sents from x),
sn as (select ss.run_id, term, list_filter(sents, lambda s: contains(lower(s), term))[1] as sn from ss join dims on dims.run_id = ss.run_id and contains(ss.low, term)),
conflicts as (select run_id, term, coalesce(bool_or({_HOLDS[0]}), false) as positive, coalesce(bool_or({_HOLDS[1]}), false) as negative from sn group by 1, 2)"""


@query(f"with {_CONFLICTS} select *, positive and negative as contradictory from conflicts")
def contradictions(spark, sf):
    s, _, terms = _dimensions(spark, sf)
    return decision.contradictions(s, terms, v.POSITIVE, v.RISK)


def _matrix(spark, sf):
    s, chosen, terms = _dimensions(spark, sf)
    return chosen, written(decision.dimension_matrix(s, _named(spark, sf), chosen, terms, decision.contradictions(s, terms, v.POSITIVE, v.RISK)))


_MATRIX = f"""{_CONFLICTS}, own as (select distinct m.run_id, m.key, m.source_id, lower(txt) as low from named m join chosen c on c.run_id = m.run_id and c.key = m.key join x on x.run_id = m.run_id and x.source_id = m.source_id),
held as (select own.run_id, key, term, count(*) as held from own join dims on dims.run_id = own.run_id and contains(low, term) group by 1, 2, 3),
cells as (select c.run_id, c.key, t.term, greatest(1, coalesce(held, 0)) as n, coalesce(positive and negative, false) as conflict from chosen c join dims t on t.run_id = c.run_id left join held h on h.run_id = c.run_id and h.key = c.key and h.term = t.term left join conflicts f on f.run_id = c.run_id and f.term = t.term),
matrix as (select run_id, key, term, n, case when n >= 3 and not conflict then 'green' when conflict or n >= 2 then 'yellow' else 'gray' end as confidence from cells)"""


@query(f"with {_MATRIX} select * from matrix")
def dimension_matrix(spark, sf):
    return _matrix(spark, sf)[1]


_SCORED = f"""{_MATRIX}, pts as (select run_id, key, sum(case confidence when 'green' then 4 when 'yellow' then 2 else 1 end) as points, cast(greatest(1, least(5, round_even(avg(case confidence when 'green' then 5 when 'yellow' then 3 else 2 end), 0))) as integer) as support, count(*) as n_dimensions from matrix group by 1, 2)"""


@query(
    f"""with {_SCORED}, tot as (select c.run_id, c.key, cast(n_sources * 3 + coalesce(points, 0) as bigint) as total, coalesce(support, 3) as support, rank from chosen c left join pts using (run_id, key)),
pl as (select *, row_number() over (partition by run_id order by total desc, rank) as place, count(*) over (partition by run_id) as n from tot) select run_id, key, total, support, place, case when place = 1 then 'primary' when place = 2 then 'backup' when place = n and n > 2 then 'caution' else '' end as pick from pl"""
)
def recommendation(spark, sf):
    return decision.recommendation(*_matrix(spark, sf))


@query(f"with {_SCORED} select c.run_id, c.key, c.name, coalesce(support, 3) as support, cast(least(5, 1 + n_sources) as integer) as confidence, coalesce(n_dimensions, 0) as n_dimensions from chosen c left join pts using (run_id, key)")
def matrix_rows(spark, sf):
    return decision.matrix_rows(*_matrix(spark, sf))


#: Characters of a transcript that decorate_sources() reads.
HEAD = 420


def _risks(spark, sf):
    return written(report.risk_terms(v.texts(spark, sf).select("run_id", F.concat_ws(" ", "title", "summary", "transcript").alias("text")), v.RISK))


def _blocks(spark, sf):
    """Report blocks of each run, built by the operators from the views."""
    s = decorated(spark, sf, HEAD)
    top = collect.top_sources(s)
    words = report.keywords(s.select("run_id", F.col("title").alias("text")), stop_words=v.STOP)
    risks = _risks(spark, sf)
    bullets = report.risk_bullets(s, risks)
    return report.report_blocks(coverage.coverage_summary(s), words, bullets, top)


_TOP = "top as (select run_id, source_id, title, row_number() over (partition by run_id order by evidence_score desc, citation_count desc, source_id) as rank from deco qualify rank <= 8)"
_BLOCKS = f"""{v.DECORATED}, {_TOP}, x as (select run_id, lower(coalesce(title, '') || ' ' || summary || ' ' || coalesce(transcript, '')) as x from src), r as ({_COUNTS}), risks as (select run_id, term, n, row_number() over (partition by run_id order by n desc, term) as rank from r where n > 0 qualify rank <= 8),
w as (select run_id, lower({_WORDS.format('title')}) as word from src), wn as (select run_id, word, count(*) as n from w where length(word) > 1 and word not in ({_STOP}) group by 1, 2), kw as (select run_id, word, row_number() over (partition by run_id order by n desc, word) as rank from wn qualify rank <= 3),
h as (select c.run_id, c.term, s.source_id, row_number() over (partition by c.run_id, c.term order by s.source_id) as nth from risks c join src s on s.run_id = c.run_id and contains(lower(coalesce(s.title, '') || ' ' || s.summary), c.term) where c.rank <= 4),
o as (select run_id, term, list(source_id order by source_id) as own from h where nth <= 3 group by 1, 2), f as (select run_id, list(source_id order by source_id) as first from (select run_id, source_id from src qualify row_number() over (partition by run_id order by source_id) <= 2) group by 1),
lead as (select run_id, list(source_id order by source_id) as ids from top where rank <= 4 group by 1),
cov as (select run_id, count(*) as sources, count(distinct platform) as platforms, sum(n_comments) as comments from src group by 1),
blocks as (
  select k.run_id, 'answer' as section_id, 'body' as block_type, 0 as pos, string_agg(word, ', ' order by rank) as text, coalesce(any_value(ids), []) as citations from kw k left join lead using (run_id) group by 1
  union all select run_id, 'coverage', 'body', 0, sources || ' sources, ' || platforms || ' platforms, ' || comments || ' comments', [] from cov
  union all select c.run_id, 'risks', 'bullet', c.rank, 'Check ''' || c.term || '''', coalesce(own, first) from risks c left join o on o.run_id = c.run_id and o.term = c.term left join f on f.run_id = c.run_id where c.rank <= 4
  union all select run_id, 'sources', 'takeaway', rank, title, [source_id] from top)"""


@query(f"with {_BLOCKS} select run_id, section_id, block_type, cast(pos as integer) as pos, text, array_to_string(citations, ',') as citations from blocks")
def report_blocks(spark, sf):
    return _blocks(spark, sf).withColumn("citations", F.array_join(F.transform("citations", lambda x: x.cast("string")), ","))


@query(f"with {_BLOCKS}, e as (select run_id, unnest(citations) as source_id from blocks) select run_id, source_id, count(*) as citation_count from e group by 1, 2")
def citation_counts(spark, sf):
    s = decorated(spark, sf)
    return report.citation_counts(s, _blocks(spark, sf)).where("citation_count > 0").select("run_id", "source_id", "citation_count")


@query(f"with {_BLOCKS}, e as (select run_id, unnest(citations) as source_id from blocks) select e.run_id, count(*) as citations, count(s.source_id) as valid from e left join (select run_id, source_id from src where source_id % 2 = 0) s on s.run_id = e.run_id and s.source_id = e.source_id group by 1")
def citation_validity(spark, sf):
    return report.citation_validity(_blocks(spark, sf), v.src(spark, sf).where("source_id % 2 = 0"))


@query(f"with {_BLOCKS}, b as (select *, sum(len(citations)) over (partition by run_id, section_id) as sc from blocks) select run_id, count(*) filter (where coalesce(text, '') <> '' and case when block_type = 'body' then section_id in ('answer', 'narrative', 'consensus_disagreement') and sc = 0 else block_type in ('takeaway', 'bullet') and len(citations) = 0 end) as uncited from b group by 1")
def uncited_blocks(spark, sf):
    return report.uncited_blocks(_blocks(spark, sf))


@query(f"with {_BLOCKS}, g as (select run_id, section_id, max(case when block_type = 'body' then text end) as body, list_sort(list_distinct(flatten(list(citations)))) as ids from blocks group by 1, 2) select run_id, section_id, case when length(body) > 80 then substr(body, 1, 80) || '...' else body end as summary, array_to_string(ids, ',') as source_ids, cast(len(ids) as integer) as n from g")
def outline(spark, sf):
    rows = report.outline(_blocks(spark, sf))
    return rows.select("run_id", "section_id", "summary", F.array_join(F.transform("source_ids", lambda x: x.cast("string")), ",").alias("source_ids"), "n")


@query(
    f"""with {_BLOCKS}, {v.LOGS}, e as (select run_id, unnest(citations) as source_id from blocks), val as (select run_id, count(*) as citations, count(*) as valid from e group by 1),
st as (select run_id, avg(evidence_score) as evidence, count(*) filter (where n_comments > 0) + count(*) filter (where coalesce(transcript, '') <> '') as channels, count(*) as n from (select distinct d.run_id, d.source_id, d.evidence_score, d.n_comments, d.transcript from deco d join e on e.run_id = d.run_id and e.source_id = d.source_id) group by 1),
c0 as (select run_id, count(*) as sources, sum(n_comments) as comments, count(distinct platform) as platforms, count(*) filter (where coalesce(transcript, '') <> '') as wt, count(*) filter (where n_comments > 0) as wc from src group by 1),
l0 as (select run_id, count(*) filter (where ok) as okr, count(*) filter (where not ok) as bad from logs group by 1),
c1 as (select c0.*, coalesce(okr, 0) as okr, coalesce(bad, 0) as bad, sources * 8 + platforms * 12 + least(30, comments) + wt * 8 + coalesce(okr, 0) * 4 as score from c0 left join l0 using (run_id)),
q as (select c1.run_id, cast(least(100, least(35, 4 * sources) + least(25, 8 * platforms) + least(20, comments) + least(20, 8 * wt)) as integer) as coverage_score, cast(greatest(0, least(100, round_even(valid / cast(greatest(1, citations) as double) * 100, 0))) as integer) as citation_score,
  cast(least(100, round_even(evidence * 1.6 + channels * 8 + least(20, 2 * n), 0)) as integer) as strength_score, case when score < 55 then 10 else 0 end + case when bad > 0 or platforms = 1 or (wc = 0 and wt = 0) then 8 else 0 end as less from c1 join val using (run_id) join st using (run_id)),
s as (select *, cast(greatest(0, least(100, round_even(strength_score * 0.35 + coverage_score * 0.25 + citation_score * 0.4, 0) - less)) as integer) as safety_score from q)
select run_id, coverage_score, citation_score, strength_score, safety_score, cast(round_even((coverage_score + citation_score + strength_score + safety_score) / 4.0, 0) as integer) as overall, case when strength_score >= 80 then 'strong' when strength_score >= 55 then 'medium' when strength_score >= 30 then 'weak' else 'insufficient' end as strength_label,
  case when safety_score >= 80 then 'low risk' when safety_score >= 55 then 'medium risk' when safety_score >= 30 then 'high risk' else 'very high risk' end as risk_label from s"""
)
def report_quality(spark, sf):
    s, blocks = decorated(spark, sf), _blocks(spark, sf)
    summary = _summary(spark, sf)
    cover = coverage.run_confidence(summary).join(report.run_warnings(summary).select("run_id", "status"), "run_id")
    cited = s.join(report.citations_of(blocks).distinct(), ["run_id", "source_id"], "left_semi")
    strength = cited.groupBy("run_id").agg(F.avg("evidence_score").alias("evidence"), (F.count_if(F.col("n_comments") > 0) + F.count_if(F.coalesce("transcript", F.lit("")) != "")).alias("channels"), F.count(F.lit(1)).alias("n"))
    return report.report_quality(cover, report.citation_validity(blocks, s), report.uncited_blocks(blocks), strength)
