"""Addresses: hosts, keys, object ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, strip_html

# fixed values: how each platform's addresses hold an object's id
OBJECT_PATTERNS = {
    "bilibili": [("video", r"/video/(BV[0-9A-Za-z]+|av\d+)"), ("creator", r"space\.bilibili\.com/(\d+)")],
    "douyin": [("video", r"/(?:video|note)/(\d+)"), ("video", r"[?&]modal_id=(\d+)"), ("creator", r"/user/([^/?#]+)")],
    "kuaishou": [("video", r"/short-video/([A-Za-z0-9_-]+)"), ("creator", r"/profile/([A-Za-z0-9_-]+)")],
    "xiaohongshu": [("note", r"/(?:explore|discovery/item)/([^/?#]+)"), ("creator", r"/user/profile/([^/?#]+)")],
    "zhihu": [("answer", r"/answer/(\d+)"), ("article", r"/p/(\d+)"), ("video", r"/zvideo/(\d+)"), ("creator", r"/people/([^/?#]+)")],
    "weibo": [("note", r"/(?:detail|status)/(\w+)"), ("creator", r"/u/(\d+)")],
    "youtube": [("video", r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{6,})"), ("creator", r"/(?:channel/|@)([^/?#]+)")],
}


def host(url: str | Column) -> Column:
    """The host of an address, without www."""
    return F.replace(F.coalesce(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("www."), F.lit(""))


def video_id(url: str | Column) -> Column:
    """The id in a watch, short or embedded address; empty if there is none."""
    return F.coalesce(F.regexp_extract(c(url), OBJECT_PATTERNS["youtube"][0][1], 1), F.lit(""))


def object_of(platform: str | Column, url: str | Column) -> Column:
    """kind and id of the object that an address of a platform names; kind is 'unknown' if none is found."""
    out = F.struct(F.lit("unknown").alias("kind"), F.lit("").alias("id"))
    for name, patterns in OBJECT_PATTERNS.items():
        for kind, pattern in reversed(patterns):
            found = F.coalesce(F.regexp_extract(c(url), pattern, 1), F.lit(""))
            out = F.when((c(platform) == name) & (found != ""), F.struct(F.lit(kind).alias("kind"), found.alias("id"))).otherwise(out)
    return out


def trace_id(url: str | Column) -> Column:
    """The last part of an image's address."""
    return F.element_at(F.split(c(url), "/"), -1)


def dedupe_key(platform: str | Column, url: str | Column, title: str | Column, compat: bool = False) -> Column:
    """Equal for rows that show the same thing: platform and address without query and closing slashes, or the
    title where there is no address. Watch addresses keep their video (compat drops it, as all queries are)."""
    low = F.lower(c(url))
    base = F.regexp_replace(F.get(F.split(low, r"\?"), F.lit(0)), "/+$", "")
    video = F.regexp_extract(c(url), r"[?&]v=([A-Za-z0-9_-]+)", 1)
    if not compat:
        base = F.when((c(platform) == "youtube") & base.endswith("/watch") & (video != ""), F.concat(base, F.lit("?v="), video)).otherwise(base)
    by_title = F.concat(c(platform), F.lit(":title:"), F.substring(F.lower(strip_html(title)), 1, 120))
    return F.when(F.coalesce(c(url), F.lit("")) != "", F.concat(c(platform), F.lit(":"), base)).otherwise(by_title)
