"""Stored tables of the platforms: their keys, schemas by rule from the normalisers, creation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import normalize as n

# fixed values: each stored table's normaliser and natural key
TABLES = {
    "bilibili_video": (n.bilibili_videos, ("video_id",)),
    "bilibili_video_comment": (n.bilibili_comments, ("comment_id",)),
    "bilibili_up_info": (n.bilibili_creators, ("user_id",)),
    "bilibili_contact_info": (lambda raw: n.bilibili_contacts(raw, raw), ("up_id", "fan_id")),
    "bilibili_up_dynamic": (n.bilibili_dynamics, ("dynamic_id",)),
    "douyin_aweme": (n.douyin_posts, ("aweme_id",)),
    "douyin_aweme_comment": (n.douyin_comments, ("comment_id",)),
    "dy_creator": (n.douyin_creators, ("user_id",)),
    "kuaishou_video": (n.kuaishou_videos, ("video_id",)),
    "kuaishou_video_comment": (n.kuaishou_comments, ("comment_id",)),
    "weibo_note": (n.weibo_notes, ("note_id",)),
    "weibo_note_comment": (n.weibo_comments, ("comment_id",)),
    "weibo_creator": (n.weibo_creators, ("user_id",)),
    "xhs_note": (n.xhs_notes, ("note_id",)),
    "xhs_note_comment": (n.xhs_comments, ("comment_id",)),
    "xhs_creator": (n.xhs_creators, ("user_id",)),
    "zhihu_content": (n.zhihu_contents, ("content_id",)),
    "zhihu_comment": (n.zhihu_comments, ("comment_id",)),
    "zhihu_creator": (n.zhihu_creators, ("user_id",)),
}

#: Columns that hold times as numbers; all others are text, as the platforms send them.
TIMES = re.compile(r"_ts$|^(create_|last_update_)?time$")
#: Columns that a normaliser may read beside the payload.
RAW = "payload string, source_keyword string, modified long, post_id string, creator_id string, creator_name string, user_id string"


def table_schema(spark: SparkSession, table: str) -> StructType:
    """The normaliser's columns and the time of adding; times are numbers."""
    columns = TABLES[table][0](spark.createDataFrame([], RAW)).columns
    return StructType([StructField(c, LongType() if TIMES.search(c) else StringType()) for c in (*columns, "add_ts")])


def create_tables(spark: SparkSession, prefix: str = "", format: str = "parquet") -> None:
    """Create the stored tables that don't exist yet, in the current database."""
    for name in TABLES:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table_schema(spark, name))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING {format}")


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns and types of a stored table: values that don't fit become null, missing columns are null."""
    has = set(df.columns)
    return df.select(*((F.col(f.name).cast("string").try_cast(f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name) for f in table_schema(df.sparkSession, table)))
