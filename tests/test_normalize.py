"""Platform records of every shape as flat tables and as sources."""

import json

from pyspark.sql import functions as F

from sourcewell.operators import normalize as n


def raw(spark, *payloads, **extra):
    rows = [(json.dumps(p, ensure_ascii=False), "kw", 1000) for p in payloads] + [("{broken", "kw", 1000)]
    df = spark.createDataFrame(rows, "payload string, source_keyword string, modified long")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_bilibili(spark):
    view = {"View": {"aid": 17, "title": "t" * 600, "desc": "d", "pubdate": 5, "pic": "p", "owner": {"mid": 3, "name": "n", "face": "f"}, "stat": {"like": 9, "view": 100}}}
    (v,) = rows(n.bilibili_videos(raw(spark, view)))
    assert v["video_url"] == "https://www.bilibili.com/video/av17" and len(v["title"]) == 500 and v["liked_count"] == "9" and v["source_keyword"] == "kw"
    fan = {"mid": 5, "uname": "x"}
    edges = {(r["up_id"], r["fan_id"]) for r in rows(n.bilibili_contacts(raw(spark, fan, creator_id=1, creator_name="c"), raw(spark, {"mid": 6}, creator_id=1, creator_name="c"))) if r["up_id"] and r["fan_id"]}
    assert edges == {("1", "5"), ("6", "1")}
    d = {"id_str": "7", "type": "DYNAMIC_TYPE_AV", "modules": {"module_dynamic": {}, "module_author": {"pub_ts": 1}, "module_stat": {"like": {"count": 2}}}}
    assert rows(n.bilibili_dynamics(raw(spark, d, creator_id=1, creator_name="c")))[0]["type"] == "AV"


def test_douyin(spark):
    post = {"aweme_id": "1", "desc": "d", "author": {"uid": "u", "avatar_thumb": {"url_list": ["a"]}}, "video": {"origin_cover": {"url_list": ["x", "y"]}, "play_addr": {"url_list": ["1", "2", "3"]}}, "images": [{"url_list": ["i1", "i2"]}, {}]}
    got = rows(n.douyin_posts(raw(spark, post, {"aweme_info": post}, {"aweme_mix_info": {"mix_items": [post]}}, {"other": 1})))
    assert len(got) == 3 and {(r["cover_url"], r["video_download_url"], r["note_download_url"], r["avatar"]) for r in got} == {("y", "3", "i2", "a")}
    c = {"cid": "9", "aweme_id": "1", "text": "hi", "user": {"avatar_thumb": {"url_list": ["z"]}}, "image_list": [{"origin_url": {"url_list": ["p", "q"]}}]}
    got = rows(n.douyin_comments(raw(spark, c, {**c, "aweme_id": "2"}, post_id="1")))
    assert len(got) == 1 and (got[0]["avatar"], got[0]["pictures"], got[0]["like_count"]) == ("z", "q", "0")


def test_xiaohongshu(spark):
    note = {"note_id": "n1", "type": "video", "title": "", "desc": "body", "image_list": [{"url": "u", "url_default": "d"}], "tag_list": [{"name": "a", "type": "topic"}, {"name": "b", "type": "x"}], "video": {"media": {"stream": {"h264": [{"master_url": "m"}]}}}, "xsec_token": "k"}
    (r,) = rows(n.xhs_notes(raw(spark, note)))
    assert (r["title"], r["image_list"], r["tag_list"], r["video_url"]) == ("body", "d", "a", "m")
    (c, _) = rows(n.xhs_creators(raw(spark, {"basicInfo": {"nickname": "q", "gender": 1}, "interactions": [{"type": "fans", "count": "5"}], "tags": [{"tagType": "t", "name": "v"}]}, user_id="u")))
    assert (c["fans"], c["follows"], c["gender"], c["tag_list"]) == ("5", "0", "Female", '{"t":"v"}')


def test_kuaishou_and_weibo(spark):
    assert [r["video_url"] for r in rows(n.kuaishou_videos(raw(spark, {"photo": {"id": "k1", "caption": "c"}}, {"photo": {}})))] == ["https://www.kuaishou.com/short-video/k1"]
    got = rows(n.kuaishou_comments(raw(spark, {"comment_id": 5, "author_id": 1}, {"commentId": "6", "authorId": "2", "subCommentCount": 3}, post_id="k1")))
    assert [(r["comment_id"], r["user_id"], r["sub_comment_count"]) for r in got[:2]] == [("5", "1", "0"), ("6", "2", "3")]
    blog = {"id": "w1", "text": "<a href=x>Hi</a> all", "created_at": "Sat Dec 23 17:12:54 +0800 2023", "region_name": "发布于 北京", "user": {"id": 4}}
    cards = raw(spark, {"card_type": 9, "mblog": blog}, {"card_type": 11, "card_group": [{"card_type": 9, "mblog": {**blog, "id": "w2"}}, {"card_type": 4}]})
    got = {r["note_id"]: r for r in rows(n.weibo_notes(n.weibo_cards(cards)))}
    assert set(got) == {"w1", "w2"} and got["w1"]["content"] == "Hi all" and got["w1"]["create_time"] == 1703322774 and got["w1"]["ip_location"] == "北京"
    assert got["w1"]["create_date_time"] == "2023-12-23 17:12:54+08:00"
    posts = spark.createDataFrame([("1", "short"), ("2", "kept")], "note_id string, content string")
    assert {r["note_id"]: r["content"] for r in rows(n.overlay_long_text(posts, posts.where("note_id = '1'").withColumn("content", F.lit("long"))))} == {"1": "long", "2": "kept"}


def test_zhihu(spark):
    author = {"id": "", "member": {"id": "m", "name": "nm", "url_token": "tok"}}
    items = [{"id": 1, "type": "answer", "content": "<p>a<b>b</b></p>", "question": {"id": 7}, "author": author}, {"id": 2, "type": "article", "created": 5, "author": {"id": "x"}}, {"id": 3, "type": "zvideo", "video": {"video_id": "v"}}, {"id": 4, "type": "ad"}]
    got = {r["content_id"]: r for r in rows(n.zhihu_contents(raw(spark, *items)))}
    assert set(got) == {"1", "2", "3"} and got["1"]["content_url"] == "https://www.zhihu.com/question/7/answer/1" and got["1"]["content_text"] == "ab" and got["1"]["user_id"] == "m"
    assert got["2"]["created_time"] == "5" and got["3"]["content_url"] == "https://www.zhihu.com/zvideo/3"
    (c,) = rows(n.zhihu_comments(raw(spark, {"id": 1, "type": "comment", "content": "x", "comment_tag": [{"type": "ip_info", "text": "京"}]}, {"id": 2, "type": "ad"}, post_id="1")))
    assert c["ip_location"] == "京"


def test_sources(spark):
    long = "段落" * 400
    z = raw(spark, {"id": 1, "type": "article", "title": "T", "content": long, "author": {"name": "A"}})
    comments = spark.createDataFrame([("1", i, f"c{i}") for i in range(6)], "object_id string, pos int, text string")
    video = raw(spark, {"View": {"aid": 2, "title": "V", "desc": "d", "stat": {"like": 3}}})
    got = {r.platform: r for r in n.all_sources({"zhihu": n.zhihu_contents(z), "bilibili": n.bilibili_videos(video)}, {"zhihu": comments}).collect()}
    assert got["zhihu"].transcript == long and len(got["zhihu"].transcript_preview) == 420 and len(got["zhihu"].summary) == 300 and got["zhihu"].comments == ["c0", "c1", "c2", "c3"]
    assert got["bilibili"].metrics == {"likes": "3"} and got["bilibili"].url.endswith("av2") and got["bilibili"].summary == "d"


def test_nested_comments(spark):
    assert n.nested_comments(raw(spark, {"id": 1, "comments": [{"id": 2}, {"id": 3}]}, post_id="p")).count() == 4


def test_repeated_and_missing_types(spark):
    """A creator's repeated tag and count types: the last entry counts, at the place of the first; none without a type."""
    many = {"interactions": [{"type": "fans", "count": 1}, {"count": 9}, {"type": "fans", "count": 2}], "tags": [{"tagType": "a", "name": "x"}, {"name": "lost"}, {"tagType": "b", "name": "y"}, {"tagType": "a", "name": "z"}]}
    got = rows(n.xhs_creators(raw(spark, many, {"interactions": [], "tags": []}, {"interactions": None}, user_id="u")))
    assert [(r["fans"], r["follows"], r["tag_list"]) for r in got] == [("2", "0", '{"a":"z","b":"y"}'), ("0", "0", "{}"), ("0", "0", "{}"), ("0", "0", "{}")]
