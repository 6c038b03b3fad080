"""Collected sources: duplicates, merging, decoration, ranking.

Sources have run_id, source_id and, as far as an operator names them, platform, url, title, summary, transcript,
creator, n_comments (int) and so on. source_id never changes; display ids are a separate column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import text as t
from ..functions.urls import dedupe_key, host

#: Rank of an evidence label.
LABEL_RANK = {"Strong": 4, "Moderate": 3, "Weak": 2, "Insufficient": 1}


def blank(x: str | Column) -> Column:
    return F.coalesce(t.c(x), F.lit("")) == ""


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order: a ranking cut at one row, which Spark applies before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key in an order, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def dedupe_sources(sources: DataFrame, compat: bool = False) -> DataFrame:
    """sources with dedupe_key; of each key of a run the first by source_id stays."""
    keyed = sources.withColumn("dedupe_key", dedupe_key("platform", "url", "title", compat))
    return first_by(keyed, ["run_id", "dedupe_key"], [F.col("source_id")])


def merge_batches(batches: list[DataFrame], cap: int = k.BUDGET["sources"]) -> DataFrame:
    """Batches in order, each key of a run once (the earliest batch wins), at most cap rows of a run; adds position."""
    rows = None
    for i, batch in enumerate(batches):
        one = batch.withColumn("batch", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    keyed = rows.withColumn("dedupe_key", dedupe_key("platform", "url", "title"))
    kept = first_by(keyed, ["run_id", "dedupe_key"], [F.col("batch"), F.col("source_id")])
    return top_by(kept, ["run_id"], [F.col("batch"), F.col("source_id")], cap, "position")


def overlay_sources(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Streamed source rows merged by key: of each column the latest value that isn't null."""
    columns = [c for c in updates.columns if c not in (*keys, order)]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return updates.groupBy(*keys).agg(F.max(order).alias(order), *latest).select(*updates.columns)


def channels(df_has: dict[str, Column] | None = None) -> Column:
    """Names of the kinds of evidence that a source has."""
    has = df_has or {"title": ~blank("title"), "comments": F.col("n_comments") > 0, "transcript": ~blank("transcript"), "url": ~blank("url")}
    return F.array_compact(F.array(*(F.when(v, name) for name, v in has.items())))


def source_type(platform: str | Column = "platform", media: str | Column = "media_type") -> Column:
    """video, note, answer, article or content, by platform and media type."""
    p, m = t.c(platform), F.lower(F.coalesce(t.c(media), F.lit("")))
    return (
        F.when(p.isin("bilibili", "douyin", "youtube"), "video")
        .when(p == "xiaohongshu", F.when(F.contains(m, F.lit("video")), "video").otherwise("note"))
        .when(p == "zhihu", F.when(F.contains(m, F.lit("video")), "video").when(F.contains(m, F.lit("answer")), "answer").otherwise("article"))
        .otherwise("content")
    )


def decorate_sources(sources: DataFrame, query_terms: list[str], media: str | Column | None = None) -> DataFrame:
    """sources plus channels, evidence_score, matches, relevance, status, source_type, domain, badges and quality.

    evidence_score is 2 for a comment, 8 for a transcript, 3 for an address and 2 for a title, up to 100; relevance
    is 35, 15 for each query term found and up to 30 for half the evidence.
    """
    score = F.least(F.lit(100), 2 * F.col("n_comments") + F.when(~blank("transcript"), 8).otherwise(0) + F.when(~blank("url"), 3).otherwise(0) + F.when(~blank("title"), 2).otherwise(0)).cast("int")
    hay = F.lower(F.concat_ws(" ", "title", "summary", F.substring("transcript", 1, 420)))
    found = F.filter(t.words(sorted({q.lower() for q in query_terms if q})), lambda q: F.contains(hay, q))
    out = sources.withColumn("channels", channels()).withColumn("evidence_score", score).withColumn("matches", found)
    half = F.least(F.lit(30), F.floor(F.col("evidence_score") / 2).cast("int"))
    relevance = F.least(F.lit(100), 35 + 15 * F.size("matches") + half) if query_terms else F.least(F.lit(100), 50 + F.col("evidence_score"))
    badges = F.slice(F.array_compact(F.array("platform", F.when(F.col("n_comments") > 0, F.concat(F.col("n_comments").cast("string"), F.lit(" comments"))), F.when(~blank("transcript"), "transcript"), F.when(~blank("url"), "openable"))), 1, 5)
    return (
        out.withColumn("relevance", relevance.cast("int"))
        .withColumn("status", F.when(F.col("evidence_score") < 5, "weak").otherwise("ranked"))
        .withColumn("source_type", source_type("platform", F.lit("") if media is None else media))
        .withColumn("domain", host("url"))
        .withColumn("badges", badges)
        .withColumn("quality", F.struct("evidence_score", "relevance", (F.col("n_comments") > 0).alias("has_comments"), (~blank("transcript")).alias("has_transcript"), F.size("channels").alias("channel_count"), "source_type"))
    )


def rank_evidence(sources: DataFrame) -> DataFrame:
    """sources (label, relevance, transcript) with display_id: label, relevance and transcript decide, then source_id."""
    rank = F.coalesce(*(F.when(F.col("label") == name, F.lit(n)) for name, n in LABEL_RANK.items()), F.lit(0))
    order = Window.partitionBy("run_id").orderBy(rank.desc(), F.col("relevance").desc(), (~blank("transcript")).desc(), F.col("source_id"))
    return sources.withColumn("display_id", F.row_number().over(order))


def top_sources(sources: DataFrame, n: int = 8) -> DataFrame:
    """The n sources of each run with most evidence, then most citations."""
    return top_by(sources, ["run_id"], [F.col("evidence_score").desc(), F.col("citation_count").desc(), F.col("source_id")], n)


def first_comments(comments: DataFrame, n: int = 3, keys: tuple[str, ...] = ("source_id",), order: str = "pos") -> DataFrame:
    """keys and comments: the first n comments (pos, text) of each source as an ordered array."""
    kept = top_by(comments, list(keys), [F.col(order)], n)
    return kept.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("comments"))


def with_comments(contents: DataFrame, comments: DataFrame, n: int = 3) -> DataFrame:
    """contents with the first n comments of each; none for contents without comments."""
    return contents.join(first_comments(comments, n), "source_id", "left").withColumn("comments", F.coalesce("comments", F.array().cast("array<string>")))


def platform_facet(sources: DataFrame) -> DataFrame:
    """Sources and cited sources of each run and platform."""
    return sources.groupBy("run_id", "platform").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("citation_count") > 0).alias("cited"))


def first_provider(rows: DataFrame, target: list[str], priority: str = "priority") -> DataFrame:
    """Rows of the first provider, by priority, that has any for a target."""
    best = Window.partitionBy(*target)
    return rows.withColumn("__best", F.min(priority).over(best)).where(F.col("__best") == F.col(priority)).drop("__best")


def daily_cap(posts: DataFrame, per_day: int, total: int) -> DataFrame:
    """posts (keyword, day, post_id): at most per_day of each keyword and day, and total of each keyword, oldest first."""
    kept = top_by(posts, ["keyword", "day"], [F.col("post_id")], per_day, "of_day")
    return top_by(kept, ["keyword"], [F.col("day"), F.col("of_day")], total, "of_all")


def capped(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most cap rows of each key, in an order: comments of a post, fans or posts of a creator."""
    return top_by(rows, keys, [F.col(o) for o in order], cap, "pos_in_key")


def contact_edges(followers: DataFrame, followings: DataFrame) -> DataFrame:
    """up_id, fan_id: followers (creator_id, contact_id) are fans of the creator, followings the other way round."""
    one = followers.select(F.col("creator_id").alias("up_id"), F.col("contact_id").alias("fan_id"))
    two = followings.select(F.col("contact_id").alias("up_id"), F.col("creator_id").alias("fan_id"))
    return one.unionByName(two).distinct()
