"""Citations of sources, moments, comments and frames: format, parse, link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .text import c
from .times import clock_to_ms, ms_to_clock

# fixed values: the citation format and the addresses it links to
PATTERN = r"^\[([A-Z]+):([^@/\]]+)([^\]]*)\]$"
MOMENT = r"^@(\d{1,2}:\d{2}(?::\d{2})?)-(\d{1,2}:\d{2}(?::\d{2})?)$"
COMMENT = r"^/comment/([^/\]]+)$"
FRAME = r"^/frame/(\d+)(?:/ocr)?$"
BASES = {
    "bilibili": "https://www.bilibili.com/video/",
    "douyin": "https://www.douyin.com/video/",
    "youtube": "https://www.youtube.com/watch?v=",
    "xiaohongshu": "https://www.xiaohongshu.com/explore/",
}


def format_citation(platform: str | Column, object_id: str | Column, start_ms: Column | None = None, end_ms: Column | None = None, comment_id: Column | None = None, frame: Column | None = None) -> Column:
    """The most exact reference that the given columns allow."""
    head = F.concat(F.lit("["), F.upper(c(platform)), F.lit(":"), c(object_id))
    tail = F.lit("]")
    out = F.concat(head, tail)
    if frame is not None:
        out = F.when(frame.isNotNull(), F.concat(head, F.lit("/frame/"), frame.cast("string"), tail)).otherwise(out)
    if comment_id is not None:
        out = F.when(comment_id.isNotNull(), F.concat(head, F.lit("/comment/"), comment_id, tail)).otherwise(out)
    if start_ms is not None and end_ms is not None:
        out = F.when(start_ms.isNotNull() & end_ms.isNotNull(), F.concat(head, F.lit("@"), ms_to_clock(start_ms), F.lit("-"), ms_to_clock(end_ms), tail)).otherwise(out)
    return out


def parse_citation(x: str | Column) -> Column:
    """platform, object_id, kind, start_ms, end_ms, comment_id, frame_index; kind is 'invalid' for other texts."""
    part = lambda of, pattern, i: F.regexp_extract(of, pattern, i)

    def outer(text: Column) -> Column:
        return F.struct(part(text, PATTERN, 1).alias("platform"), part(text, PATTERN, 2).alias("object_id"), part(text, PATTERN, 3).alias("suffix"), F.coalesce(text.rlike(PATTERN), F.lit(False)).alias("known"))

    def inner(o: Column) -> Column:
        s = o["suffix"]
        return F.struct(o.alias("o"), clock_to_ms(part(s, MOMENT, 1)).alias("start"), clock_to_ms(part(s, MOMENT, 2)).alias("end"))

    def kind(i: Column) -> Column:
        s, start, end = i["o"]["suffix"], i["start"], i["end"]
        told = F.when(~i["o"]["known"], "invalid").when(s == "", "source").when(s.rlike(MOMENT), F.when(start.isNotNull() & end.isNotNull() & (end >= start), "timestamp").otherwise("invalid"))
        return F.struct(i.alias("i"), told.when(s.rlike(COMMENT), "comment").when(s.rlike(FRAME), "frame").otherwise("invalid").alias("kind"))

    def fields(f: Column) -> Column:
        i, o, good = f["i"], f["i"]["o"], f["kind"] != "invalid"
        moment = f["kind"] == "timestamp"
        return F.struct(
            F.when(good, o["platform"]).otherwise("").alias("platform"), F.when(good, o["object_id"]).otherwise("").alias("object_id"), f["kind"].alias("kind"), F.when(moment, i["start"]).alias("start_ms"), F.when(moment, i["end"]).alias("end_ms"),
            F.when(good, part(o["suffix"], COMMENT, 1)).otherwise("").alias("comment_id"), F.when(good, part(o["suffix"], FRAME, 1)).try_cast("int").alias("frame_index"),
        )

    # Each step's values are worked out once; as one expression they would be repeated until no compiler takes them.
    return t.let(t.let(t.let(t.let(F.trim(c(x)), outer), inner), kind), fields)


def link(cited: str | Column, source_url: Column | None = None) -> Column:
    """Address of a parsed citation: the source's own or the platform's, with the moment or comment where it can."""
    p = c(cited)
    own = F.coalesce(source_url, F.lit("")) if source_url is not None else F.lit("")
    base = own
    for name, prefix in BASES.items():
        base = F.when((own == "") & (F.lower(p["platform"]) == name), F.concat(F.lit(prefix), p["object_id"])).otherwise(base)
    joint = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    seconds = F.floor(p["start_ms"] / 1000).cast("string")
    return (
        F.when((F.lower(p["platform"]) == "bilibili") & p["start_ms"].isNotNull(), F.concat(base, joint, F.lit("t="), seconds))
        .when((F.lower(p["platform"]) == "youtube") & p["start_ms"].isNotNull(), F.concat(base, joint, F.lit("t="), seconds, F.lit("s")))
        .when((F.lower(p["platform"]) == "douyin") & (p["comment_id"] != ""), F.concat(base, joint, F.lit("comment_id="), F.url_encode(p["comment_id"])))
        .otherwise(base)
    )
