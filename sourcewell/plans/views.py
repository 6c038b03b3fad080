"""The driver's tables seen as research data: each view as a DataFrame and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PLATFORMS
from ..operators.storage import written

#: Words that the synthetic texts have; term lists are parameters of the operators.
QUERY_TERMS = ["the", "best", "und", "que", "les"]
STOP = ("the", "and", "of", "in", "to", "is", "a")
POSITIVE, RISK = ("was", "with", "der", "los"), ("no", "pathetic", "idiot", "worthless", "trash", "moron")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _platform(column: str):
    out = F.lit(PLATFORMS[-1])
    for i, p in reversed(list(enumerate(PLATFORMS[:-1]))):
        out = F.when(F.pmod(F.col(column), F.lit(7)) == i, p).otherwise(out)
    return out


_PLATFORM_SQL = "case {0} % 7 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PLATFORMS[:-1])) + f" else '{PLATFORMS[-1]}' end"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents alone, for queries that need whole texts and nothing of other tables: no text is shuffled for a join."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.col("text").alias("transcript"), F.col("source").alias("creator"))


DOCS = "src as (select doc_id as source_id, substr(split_part(text, chr(10), 1), 1, 120) as title, text as transcript, source as creator from documents)"


def _doc_rows(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").alias("source_id"), (F.col("doc_id") % 10).alias("run_id"), _platform("doc_id").alias("platform"),
        F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.lit("").alias("summary"), *more,
    )


def src(spark: SparkSession, sf_dir: str, head: int | None = None) -> DataFrame:
    """Documents as sources of ten runs, with labels and the number of user turns as comments.

    With head, transcript is no more than that many characters: for queries that read only a text's beginning, or whether
    there is one, so that no whole text travels for the joins.
    """
    tail = F.when(F.col("doc_id") % 2 == 0, "?ref=x").otherwise("/")
    # What a document tells is made before the joins: a query that needs no whole text then sends none to them.
    docs = _doc_rows(
        spark, sf_dir, (F.col("text") if head is None else F.substring("text", 1, head)).alias("transcript"),
        F.col("source").alias("creator"), F.concat(F.lit("https://example.com/v/"), (F.col("doc_id") % 800).cast("string"), tail).alias("url"),
        (F.col("doc_id") % 3).alias("citation_count"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("20"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0"), F.lit("-07-15"))).alias("published"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    comments = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("n_comments"))
    rows = docs.join(labels, "doc_id", "left").join(comments, "doc_id", "left")
    return rows.select(
        "source_id", "run_id", "platform", "title", "summary", "transcript", "creator", "url",
        F.coalesce("n_comments", F.lit(0)).alias("n_comments"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("verified"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("sponsored"),
        "citation_count", "published",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, run_id, title, summary and whole transcript of the rows of src(), which has a document once for each of its
    labels. Only ids with several labels, mostly none, are joined: a small table is sent to the texts then."""
    docs = _doc_rows(spark, sf_dir, F.col("text").alias("transcript"))
    several = written(table(spark, sf_dir, "labels").groupBy("doc_id").count().where("count > 1"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("count", F.lit(1).cast("long"))))
    return docs.join(several, "doc_id", "left").select("source_id", "run_id", "title", "summary", "transcript", copies.alias("copy")).drop("copy")


SRC = f"""src as (
  select d.doc_id as source_id, d.doc_id % 10 as run_id, {_PLATFORM_SQL.format('d.doc_id')} as platform,
    substr(split_part(d.text, chr(10), 1), 1, 120) as title, '' as summary, d.text as transcript, d.source as creator,
    'https://example.com/v/' || cast(d.doc_id % 800 as varchar) || case when d.doc_id % 2 = 0 then '?ref=x' else '/' end as url,
    coalesce(c.n, 0) as n_comments, coalesce(l.quality = 1, false) as verified, coalesce(l.toxic = 1, false) as sponsored,
    d.doc_id % 3 as citation_count,
    case when d.doc_id % 5 = 0 then '' else '20' || lpad(cast(d.doc_id % 30 as varchar), 2, '0') || '-07-15' end as published
  from documents d left join labels l on l.doc_id = d.doc_id
  left join (select conv_id, count(*) as n from conversations where role = 'user' group by 1) c on c.conv_id = d.doc_id)"""

#: Sources with evidence score and relevance as decorate_sources() gives them for QUERY_TERMS.
_HITS = " + ".join(f"cast(contains(hay, '{q}') as int)" for q in sorted(QUERY_TERMS))
DECORATED = f"""{SRC}, scored as (
  select *, least(100, 2 * n_comments + case when coalesce(transcript, '') <> '' then 8 else 0 end + 3 + case when coalesce(title, '') <> '' then 2 else 0 end) as evidence_score,
    lower(coalesce(title, '') || ' ' || summary || ' ' || substr(coalesce(transcript, ''), 1, 420)) as hay from src),
deco as (select *, {_HITS} as n_matches, least(100, 35 + 15 * ({_HITS}) + least(30, evidence_score // 2)) as relevance from scored)"""


def logs(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """Events as provider runs of the ten research runs, or of one run for each user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") if by_user else F.col("user_id") % 10).alias("run_id"), _platform("event_id").alias("platform"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 3).alias("count"),
        F.when(F.col("event_type") == "error", "permission denied").otherwise(F.col("event_type")).alias("note"),
    )


LOGS = f"""logs as (select user_id % 10 as run_id, {_PLATFORM_SQL.format('event_id')} as platform, event_id as seq, event_type <> 'error' as ok, event_id % 3 as count,
  case when event_type = 'error' then 'permission denied' else event_type end as note from events)"""


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the event log of one run for each user."""
    e = table(spark, sf_dir, "events")
    kind = F.expr("case event_type when 'signup' then 'run_started' when 'view' then 'sources' when 'click' then 'section_delta' when 'purchase' then 'final_report' else 'error' end")
    return e.select(F.col("user_id").alias("run_id"), "event_id", "ts", kind.alias("type"), (F.col("event_id") % 101).cast("int").alias("progress"), F.col("event_type").alias("message"), F.lit(None).cast("string").alias("payload"))


RUNLOG = """runlog as (select user_id as run_id, event_id, ts, case event_type when 'signup' then 'run_started' when 'view' then 'sources' when 'click' then 'section_delta' when 'purchase' then 'final_report' else 'error' end as type,
  cast(event_id % 101 as integer) as progress, event_type as message, row_number() over (partition by user_id order by ts, event_id) as sequence from events)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as timed transcript segments."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), "text", (F.col("turn") * 10_000).alias("start_ms"), (F.col("turn") * 10_000 + 9_000).alias("end_ms"), (((F.col("conv_id") + F.col("turn")) % 10) / 10).alias("asr_confidence"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as comments."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("pos"), "text")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for each run: platforms by run, entities that some texts hold, intents."""
    runs = src(spark, sf_dir).select("run_id").distinct()
    return runs.select(
        "run_id", F.array(F.lit("bilibili"), F.lit("youtube"), F.lit("tiktok")).alias("platforms"), F.array(F.lit("The"), F.lit("Pathetic"), F.lit("zebra crossing")).alias("entities"), F.array(F.lit("review"), F.lit("complaint"), F.lit("ocr")).alias("intents")
    )


def post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts found by keyword and day."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("keyword"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("post_id"), "o_orderdate", "o_totalprice")
