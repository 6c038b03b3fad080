"""Queries of the platform normalisers: records are made from documents as JSON texts and read back as flat tables.

A record takes ids, texts, names and counts from its document. Fields are missing, null or empty in turn, the places that a
column tries are filled in turn, lists have no, one or several entries, and posts come plain or inside search rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import normalize as n
from . import views as v

QUERIES, SQL = {}, {}

_NEEDED = {"View.aid", "Card.card.mid", "aweme_id", "note_id", "mblog.id", "photo.id"}  # records without these are left out
_TEXTS = {"title", "desc", "message", "sign", "signature", "text", "caption", "content", "user_text", "description"}
_COUNTS = {"like", "view", "favorite", "share", "coin", "danmaku", "reply", "fans", "rcount", "count", "follow", "fan", "realLikeCount", "viewCount", "like_num"}


def _list(entry: str, sizes: str = "source_id % 5 - 1", kind: str = "spark") -> str:
    """SQL of a list of entries made of i = 1, 2, 3: null for size -1."""
    if kind == "spark":
        return f"case when {sizes} >= 0 then transform(slice(array(1, 2, 3), 1, cast({sizes} as int)), i -> {entry}) end"
    return f"case when {sizes} >= 0 then list_transform([1, 2, 3][1:{sizes}], lambda i: {entry}) end"


def _both(entry: str, sizes: str = "source_id % 5 - 1") -> str:
    return _list(entry, sizes, "duckdb")


#: A record has these values at these places: by table and path, as Spark SQL; what DuckDB shall find is said at each query.
_URLS = "'https://img.example.com/' || source_id || '/' || {0}"
_DATE = "date_format(cast(timestampadd(second, cast(source_id * 7919 % 30000000 as int), timestamp_ntz '2023-03-01 00:00:00') as timestamp), 'EEE MMM dd HH:mm:ss') || case source_id % 2 when 0 then ' +0800' else ' +0000' end || date_format(cast(timestampadd(second, cast(source_id * 7919 % 30000000 as int), timestamp_ntz '2023-03-01 00:00:00') as timestamp), ' yyyy')"
_HTML = "'<p>' || title || '</p><script>var a = 1;</script>\n <b>' || creator || '</b>'"
OWN = {
    "bilibili_up_dynamic": {"type": "case source_id % 3 when 0 then 'DYNAMIC_TYPE_AV' when 1 then 'DYNAMIC_TYPE_WORD' end"},
    "douyin_aweme": {
        "video.play_addr_h264.url_list": _list(_URLS.format("'h' || i"), "source_id % 4 - 1"),
        "video.play_addr_256.url_list": _list(_URLS.format("'m' || i"), "source_id % 3 - 1"),
        "video.play_addr.url_list": _list(_URLS.format("'p' || i")),
        "images": _list(f"named_struct('url_list', case when (source_id + i) % 3 > 0 then array({_URLS.format('i')}, {_URLS.format('(i + 10)')}) end)"),
    },
    "douyin_aweme_comment": {"image_list": _list(f"named_struct('origin_url', named_struct('url_list', case when (source_id + i) % 3 > 0 then array({_URLS.format('i')}, {_URLS.format('(i + 10)')}) else array({_URLS.format('i')}) end))")},
    "dy_creator": {"user.gender": "case source_id % 4 when 0 then 0 when 1 then 1 when 2 then 2 end", "user.avatar_300x300.uri": "'uri' || source_id"},
    "xhs_creator": {
        "basicInfo.gender": "case source_id % 3 when 0 then 0 when 1 then 1 end",
        "interactions": _list("named_struct('type', case i when 1 then 'fans' when 2 then 'follows' else 'fans' end, 'count', source_id % 1000 + i)"),
        "tags": _list("named_struct('tagType', case when i = 3 then 't1' else 't' || i end, 'name', creator || i)"),
    },
    "kuaishou_creator": {"profile.gender": "case source_id % 3 when 0 then 'F' when 1 then 'M' end"},
    "weibo_note": {"mblog.created_at": _DATE, "mblog.region_name": "case when source_id % 3 > 0 then '发布于 ' || creator end", "mblog.text": "'<a href=\"x\">' || title || '</a> ' || transcript"},
    "weibo_note_comment": {"created_at": _DATE, "source": "case when source_id % 3 > 0 then '来自' || creator end", "user.gender": "case source_id % 3 when 0 then 'f' when 1 then 'm' end", "text": "'<b>' || title || '</b>'"},
    "weibo_creator": {"gender": "case source_id % 3 when 0 then 'f' when 1 then 'm' end", "source": "case when source_id % 3 > 0 then '来自' || creator end"},
    "zhihu_content": {"type": "case source_id % 4 when 0 then 'answer' when 1 then 'article' when 2 then 'zvideo' else 'pin' end", "content": _HTML, "title": "title", "video.video_id": "case when source_id % 8 = 2 then 'v' || source_id end"},
    "zhihu_comment": {"type": "case source_id % 3 when 0 then 'notice' else 'comment' end", "content": _HTML, "comment_tag": _list("named_struct('type', case when (source_id + i) % 2 = 0 then 'ip_info' else 'other' end, 'text', creator || i)")},
    "zhihu_creator": {"gender": "case source_id % 4 when 0 then 0 when 1 then 1 when 2 then -1 end"},
    "xhs_note": {
        "type": "case source_id % 3 when 0 then 'normal' else 'video' end", "title": "case source_id % 4 when 0 then '' when 1 then null else title end",
        "video.consumer.origin_video_key": "case source_id % 5 when 0 then 'k' || source_id when 1 then '' end", "video.consumer.originVideoKey": "case source_id % 5 when 1 then 'o' || source_id when 2 then 'o' || source_id end",
        "video.media.stream.h264": _list(f"named_struct('master_url', {_URLS.format('i')})", "source_id % 4"),
        "image_list": _list(f"named_struct('url', {_URLS.format('i')}, 'url_default', case when (source_id + i) % 3 = 0 then '' when (source_id + i) % 3 = 1 then 'd' || i end)"),
        "tag_list": _list("named_struct('name', creator || i, 'type', case when (source_id + i) % 3 = 0 then 'other' else 'topic' end)"),
    },
    "xhs_note_comment": {"pictures": _list(f"named_struct('url_default', {_URLS.format('i')})")},
}


def _value(table: str, path: str) -> str:
    """SQL of the value at a place of a table's records, for Spark and DuckDB alike."""
    if path in OWN.get(table, {}):
        return OWN[table][path]
    word = re.sub(r"\[\d+\]", "", path).split(".")[-1]
    if path in _NEEDED:
        return f"case when source_id % 13 <> 5 then '{path}:' || source_id end"
    if word in _TEXTS:
        return "transcript"
    if word in _COUNTS or word.endswith(("_count", "Count", "_total")):
        return f"case when source_id % 7 <> {len(path) % 7} then cast(n_comments * 3 + source_id % {89 + len(path)} as bigint) end"
    if word.endswith(("id", "Id")):
        return f"'{path}:' || source_id"
    return f"case when source_id % 7 <> {len(path) % 7} then creator || '/{path}/' || source_id end"


def _places(table: str, column: str) -> list[tuple[str, str]]:
    """The places that a column tries, with their values: the first that has one is another from record to record, those
    before it are empty or missing, and some records have none."""
    paths = n.PATHS[table][column].split("|")
    if len(paths) == 1:
        return [(paths[0], _value(table, paths[0]))]
    return [(p, f"case when source_id % {len(paths) + 1} <= {i} then '{p}:' || source_id when source_id % 2 = 0 then '' end") for i, p in enumerate(paths)]


def _read(table: str, column: str) -> str:
    """DuckDB's SQL of what a column shall hold if it is read as it stands."""
    places = _places(table, column)
    if len(places) == 1:
        return f"cast({places[0][1]} as varchar)"
    return f"coalesce({', '.join(f'''nullif({x}, '')''' for _, x in places)})"


def _payload(table: str):
    """The record of a table as JSON; fields without a value are missing in one half of the records and null in the other."""
    tree: dict = {}
    values = {p: x for c in n.PATHS[table] for p, x in _places(table, c)} | OWN.get(table, {})
    for path, value in values.items():
        node, parts = tree, re.findall(r"[^.\[\]]+|\[\d+\]", path)
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node[parts[-1]] = F.expr(value)

    def build(node):
        if not isinstance(node, dict):
            return node
        if all(k.startswith("[") for k in node):
            last = max(int(k[1:-1]) for k in node)
            return F.array(*(build(node[f"[{i}]"]) if f"[{i}]" in node else F.lit("") for i in range(last + 1)))
        return F.struct(*(build(x).alias(k) for k, x in node.items()))

    record = build(tree)
    return F.when(F.col("source_id") % 2 == 0, F.to_json(record)).otherwise(F.to_json(record, {"ignoreNullFields": "false"}))


def _raw(spark, sf, table: str, post: str) -> DataFrame:
    s = v.src(spark, sf)
    i = F.col("source_id").cast("string")
    return s.select(_payload(table).alias("payload"), F.lit("kw").alias("source_keyword"), F.lit(7).cast("long").alias("modified"), F.expr(post).alias("post_id"), i.alias("user_id"), i.alias("creator_id"), F.concat(F.lit("C"), i).alias("creator_name"), "source_id")


def _wrapped(raw: DataFrame) -> DataFrame:
    """Posts in the three forms of search rows: plain, inside, and first of a mix."""
    p = F.col("payload")
    form = F.when(F.col("source_id") % 3 == 0, p).when(F.col("source_id") % 3 == 1, F.concat(F.lit('{"aweme_info":'), p, F.lit("}")))
    return raw.withColumn("payload", F.coalesce(form, F.concat(F.lit('{"aweme_mix_info":{"mix_items":['), p, F.lit(',{"aweme_id":"second"}]}}'))))


def _register(table: str, f, made: dict[str, str] | None = None, where: str = "true", post: str = "cast(source_id as string)", skip: tuple[str, ...] = ()) -> None:
    """A query of a normaliser: columns read by path, and the ones that it makes, by their SQL."""
    made = made or {}
    columns = {c: _read(table, c) for c in n.PATHS[table] if c not in skip} | made | {"source_keyword": "'kw'", "last_modify_ts": "cast(7 as bigint)"}

    def run(spark, sf):
        return f(_raw(spark, sf, table, post)).select(*columns)

    QUERIES[table] = run
    SQL[table] = f"with {v.SRC} select {', '.join(f'{x} as {c}' for c, x in columns.items())} from src where {where}"


def _zero(table: str, *columns: str) -> dict[str, str]:
    return {c: f"coalesce({_read(table, c)}, '0')" for c in columns}


def _cut(table: str, *columns: str) -> dict[str, str]:
    return {c: f"substr(coalesce({_read(table, c)}, ''), 1, 500)" for c in columns}


def _joined(entries: str, keep: str = "x is not null") -> str:
    """DuckDB's SQL of a list's kept entries, joined by commas; '' without a list."""
    return f"coalesce(array_to_string(list_filter({entries}, lambda x: {keep}), ','), '')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '(?is)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"


def _have(path: str) -> str:
    return "source_id % 13 <> 5" if path in _NEEDED else "true"


_PLACE = {"ip_location": "case when source_id % 3 > 0 then coalesce(creator, '') else '' end"}
_CLOCK = "timestamp '2023-03-01 00:00:00' + to_seconds(source_id * 7919 % 30000000)"
_WHEN = {
    "create_time": f"cast(epoch({_CLOCK}) as bigint) - case source_id % 2 when 0 then 28800 else 0 end",
    "create_date_time": f"strftime({_CLOCK} + to_hours(case source_id % 2 when 0 then 0 else 8 end), '%Y-%m-%d %H:%M:%S') || '+08:00'",
}
_USER = {"user_id": "cast(source_id as varchar)"}
_FIRST = "case when source_id % 4 > 1 then 'h' || (source_id % 4 - 1) when source_id % 3 > 1 then 'm' || (source_id % 3 - 1) when source_id % 5 > 1 then 'p' || (source_id % 5 - 1) end"
_TOKEN = "'https://www.zhihu.com/people/' || "

_register("bilibili_video", n.bilibili_videos, _cut("bilibili_video", "title", "desc") | {"video_type": "'video'", "video_url": "'https://www.bilibili.com/video/av' || 'View.aid:' || source_id"}, _have("View.aid"))
_register("bilibili_up_info", n.bilibili_creators, where=_have("Card.card.mid"))
_register("bilibili_video_comment", n.bilibili_comments, _zero("bilibili_video_comment", "parent_comment_id", "sub_comment_count", "like_count") | {"video_id": "cast(source_id as varchar)"})
_register("bilibili_up_dynamic", n.bilibili_dynamics, {"type": "case source_id % 3 when 0 then 'AV' when 1 then 'WORD' end", "text": "coalesce(transcript, '')", "user_id": "cast(source_id as varchar)", "user_name": "'C' || source_id"})
_register(
    "douyin_aweme", lambda raw: n.douyin_posts(_wrapped(raw)),
    {
        "aweme_url": "'https://www.douyin.com/video/aweme_id:' || source_id", "cover_url": f"coalesce({_read('douyin_aweme', 'cover_url')}, '')",
        # a list with one address only gives none, and lists after it aren't asked
        "video_download_url": f"case when regexp_matches({_FIRST}, '[23]$') then {_URLS.format(_FIRST)} else '' end",
        "note_download_url": _joined(_both(f"case when (source_id + i) % 3 > 0 then {_URLS.format('(i + 10)')} end")),
    },
    _have("aweme_id"),
)
_register(
    "douyin_aweme_comment", n.douyin_comments,
    _zero("douyin_aweme_comment", "like_count", "sub_comment_count", "parent_comment_id") | {"pictures": _joined(_both(f"case when (source_id + i) % 3 > 0 then {_URLS.format('(i + 10)')} end"))},
    f"source_id % 2 = 0 and {_have('aweme_id')}", "case when source_id % 2 = 0 then concat('aweme_id:', source_id) else 'other' end",
)
_register("dy_creator", n.douyin_creators, _USER | {"gender": "case source_id % 4 when 1 then 'Male' when 2 then 'Female' else 'Unknown' end", "avatar": "'https://p3-pc.douyinpic.com/img/uri' || source_id || '~c5_300x300.jpeg?from=2956013662'"})
_register(
    "xhs_note", n.xhs_notes,
    {
        "title": f"coalesce(nullif({OWN['xhs_note']['title']}, ''), substr(coalesce(transcript, ''), 1, 255))", "last_update_time": f"coalesce({_read('xhs_note', 'last_update_time')}, '0')",
        "video_url": f"case when source_id % 3 = 0 then '' when source_id % 5 = 0 then 'http://sns-video-bd.xhscdn.com/k' || source_id when source_id % 5 < 3 then 'http://sns-video-bd.xhscdn.com/o' || source_id else {_joined(_both(_URLS.format('i'), 'source_id % 4'))} end",
        "image_list": _joined(_both(f"case when (source_id + i) % 3 = 1 then 'd' || i else {_URLS.format('i')} end")),
        "tag_list": _joined(_both("case when (source_id + i) % 3 <> 0 then coalesce(creator || i, '') end")),
        "note_url": f"'https://www.xiaohongshu.com/explore/note_id:' || source_id || '?xsec_token=' || coalesce({_read('xhs_note', 'xsec_token')}, '') || '&xsec_source=pc_search'",
    },
    _have("note_id"),
)
_register("xhs_note_comment", n.xhs_comments, _zero("xhs_note_comment", "sub_comment_count", "parent_comment_id", "like_count") | {"note_id": "cast(source_id as varchar)", "pictures": _joined(_both(_URLS.format("i")))})
_register(
    "xhs_creator", n.xhs_creators,
    _USER | {
        "gender": "case source_id % 3 when 0 then 'Male' when 1 then 'Female' end", "interaction": "'0'", "follows": "case when source_id % 5 > 2 then cast(source_id % 1000 + 2 as varchar) else '0' end",
        "fans": "case source_id % 5 when 4 then cast(source_id % 1000 + 3 as varchar) when 0 then '0' when 1 then '0' else cast(source_id % 1000 + 1 as varchar) end",
        "tag_list": "case source_id % 5 when 2 then '{\"t1\":\"' || creator || '1\"}' when 3 then '{\"t1\":\"' || creator || '1\",\"t2\":\"' || creator || '2\"}' when 4 then '{\"t1\":\"' || creator || '3\",\"t2\":\"' || creator || '2\"}' else '{}' end",
    },
)
_register("kuaishou_video", n.kuaishou_videos, _cut("kuaishou_video", "title", "desc") | {"video_url": "'https://www.kuaishou.com/short-video/photo.id:' || source_id"}, _have("photo.id"))
_register("kuaishou_video_comment", n.kuaishou_comments, _zero("kuaishou_video_comment", "sub_comment_count") | {"video_id": "cast(source_id as varchar)"})
_register("kuaishou_creator", n.kuaishou_creators, _USER | {"gender": "case source_id % 3 when 0 then 'Female' when 1 then 'Male' end", "ip_location": "''"})
_register("weibo_note", n.weibo_notes, _PLACE | _WHEN | {"content": "regexp_replace('<a href=\"x\">' || title || '</a> ' || transcript, '<.*?>', '', 'g')", "note_url": "'https://m.weibo.cn/detail/mblog.id:' || source_id"}, _have("mblog.id"), skip=("created_at",))
_register("weibo_note_comment", n.weibo_comments, _PLACE | _WHEN | {"content": "regexp_replace('<b>' || title || '</b>', '<.*?>', '', 'g')", "note_id": "cast(source_id as varchar)"}, skip=("created_at",))
_register("weibo_creator", n.weibo_creators, _USER | _PLACE | {"gender": "case source_id % 3 when 0 then 'Female' when 1 then 'Male' end", "tag_list": "''"})
_register(
    "zhihu_content", n.zhihu_contents,
    {
        "content_text": _clean(_HTML), "title": _clean("title"), "desc": _clean(_read("zhihu_content", "desc")), "user_link": f"{_TOKEN}{_read('zhihu_content', 'user_url_token')}",
        "content_url": f"case source_id % 4 when 0 then 'https://www.zhihu.com/question/question.id:' || source_id || '/answer/id:' || source_id when 1 then 'https://zhuanlan.zhihu.com/p/id:' || source_id else case when source_id % 8 = 2 then 'https://www.zhihu.com/zvideo/id:' || source_id else coalesce({_read('zhihu_content', 'video_url')}, 'https://www.zhihu.com/zvideo/id:' || source_id) end end",
    },
    "source_id % 4 <> 3", skip=("video_url",),
)
_register(
    "zhihu_comment", n.zhihu_comments,
    _zero("zhihu_comment", "like_count", "dislike_count") | {
        "content": _clean(_HTML), "content_id": "cast(source_id as varchar)", "user_link": f"{_TOKEN}{_read('zhihu_comment', 'url_token')}",
        "ip_location": f"coalesce(list_filter({_both('case when (source_id + i) % 2 = 0 then creator || i end')}, lambda x: x is not null)[1], '')",
    },
    "source_id % 3 <> 0", skip=("url_token",),
)
_register("zhihu_creator", n.zhihu_creators, {"gender": "case source_id % 4 when 0 then 'Female' when 1 then 'Male' else 'Unknown' end", "user_link": f"{_TOKEN}{_read('zhihu_creator', 'url_token')}"})


def to_source(spark, sf):
    tables = {"bilibili": n.bilibili_videos(_raw(spark, sf, "bilibili_video", "''")), "weibo": n.weibo_notes(_raw(spark, sf, "weibo_note", "''")), "kuaishou": n.kuaishou_videos(_raw(spark, sf, "kuaishou_video", "''"))}
    s = n.all_sources(tables)
    return s.select("platform", "object_id", "title", "creator", "url", "published", "summary", "transcript", F.col("metrics")["likes"].alias("likes"))


def _tight(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"


def _video(platform: str, table: str, key: str, base: str, title: str, creator: str, time: str, likes: str) -> str:
    body = _tight(f"substr(coalesce({title}, ''), 1, 500)")
    return f"""select '{platform}' as platform, '{key}:' || source_id as object_id, {{title}} as title, coalesce({_read(table, creator)}, '') as creator, '{base}{key}:' || source_id as url,
  coalesce({_read(table, time)}, '') as published, substr({body}, 1, 300) as summary, '' as transcript, {_read(table, likes)} as likes from src where {_have(key)}""".replace("{title}", f"coalesce(nullif({body}, ''), 'Untitled')")


_BLOG = _tight("regexp_replace('<a href=\"x\">' || title || '</a> ' || transcript, '<.*?>', '', 'g')")
QUERIES["to_source"] = to_source
SQL["to_source"] = f"""with {v.SRC} {_video('bilibili', 'bilibili_video', 'View.aid', 'https://www.bilibili.com/video/av', 'transcript', 'nickname', 'create_time', 'liked_count')}
union all {_video('kuaishou', 'kuaishou_video', 'photo.id', 'https://www.kuaishou.com/short-video/', 'transcript', 'nickname', 'create_time', 'liked_count')}
union all select 'weibo', 'mblog.id:' || source_id, coalesce(nullif(substr({_BLOG}, 1, 48), ''), 'Untitled'), coalesce({_read('weibo_note', 'nickname')}, ''), 'https://m.weibo.cn/detail/mblog.id:' || source_id,
  cast({_WHEN['create_time']} as varchar), substr({_BLOG}, 1, 300), {_BLOG}, {_read('weibo_note', 'liked_count')} from src where {_have('mblog.id')}"""
