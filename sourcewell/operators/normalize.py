"""Raw platform records as flat tables, and all platforms as one table of sources.

Raw tables have payload (JSON text), source_keyword and modified (epoch ms); comment and contact tables also have
post_id or creator fields. Each payload is parsed once, into a VARIANT, and one projection reads the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.times import from_rfc2822

# fixed values: where each column of a table is in the platform's record; "|" separates the places tried in turn
PATHS: dict[str, dict[str, str]] = {
    "bilibili_video": {
        "video_id": "View.aid", "title": "View.title", "desc": "View.desc", "create_time": "View.pubdate", "user_id": "View.owner.mid", "nickname": "View.owner.name", "avatar": "View.owner.face",
        "liked_count": "View.stat.like", "disliked_count": "View.stat.dislike", "video_play_count": "View.stat.view", "video_favorite_count": "View.stat.favorite", "video_share_count": "View.stat.share",
        "video_coin_count": "View.stat.coin", "video_danmaku": "View.stat.danmaku", "video_comment": "View.stat.reply", "video_cover_url": "View.pic",
    },
    "bilibili_up_info": {
        "user_id": "Card.card.mid", "nickname": "Card.card.name", "sex": "Card.card.sex", "sign": "Card.card.sign", "avatar": "Card.card.face", "total_fans": "Card.card.fans", "total_liked": "Card.like_num",
        "user_rank": "Card.card.level_info.current_level", "is_official": "Card.card.official_verify.type",
    },
    "bilibili_video_comment": {
        "comment_id": "rpid", "parent_comment_id": "parent", "create_time": "ctime", "content": "content.message", "user_id": "member.mid", "nickname": "member.uname", "sex": "member.sex", "sign": "member.sign",
        "avatar": "member.avatar", "sub_comment_count": "rcount", "like_count": "like",
    },
    "bilibili_contact": {"id": "mid", "name": "uname", "sign": "sign", "avatar": "face"},
    "bilibili_up_dynamic": {
        "dynamic_id": "id_str", "text": "modules.module_dynamic.desc.text", "type": "type", "pub_ts": "modules.module_author.pub_ts", "total_comments": "modules.module_stat.comment.count",
        "total_forwards": "modules.module_stat.forward.count", "total_liked": "modules.module_stat.like.count",
    },
    "douyin_aweme": {
        "aweme_id": "aweme_id", "aweme_type": "aweme_type", "title": "desc", "desc": "desc", "create_time": "create_time", "user_id": "author.uid", "sec_uid": "author.sec_uid", "short_user_id": "author.short_id",
        "user_unique_id": "author.unique_id", "user_signature": "author.signature", "nickname": "author.nickname", "avatar": "author.avatar_thumb.url_list[0]", "liked_count": "statistics.digg_count",
        "collected_count": "statistics.collect_count", "comment_count": "statistics.comment_count", "share_count": "statistics.share_count", "ip_location": "ip_label", "music_download_url": "music.play_url.uri",
        "cover_url": "video.raw_cover.url_list[1]|video.origin_cover.url_list[1]",
    },
    "douyin_aweme_comment": {
        "comment_id": "cid", "aweme_id": "aweme_id", "create_time": "create_time", "ip_location": "ip_label", "content": "text", "user_id": "user.uid", "sec_uid": "user.sec_uid", "short_user_id": "user.short_id",
        "user_unique_id": "user.unique_id", "user_signature": "user.signature", "nickname": "user.nickname", "sub_comment_count": "reply_comment_total", "like_count": "digg_count", "parent_comment_id": "reply_id",
        "avatar": "user.avatar_medium.url_list[0]|user.avatar_300x300.url_list[0]|user.avatar_168x168.url_list[0]|user.avatar_thumb.url_list[0]",
    },
    "dy_creator": {
        "nickname": "user.nickname", "gender": "user.gender", "avatar": "user.avatar_300x300.uri", "desc": "user.signature", "ip_location": "user.ip_location", "follows": "user.following_count",
        "fans": "user.max_follower_count", "interaction": "user.total_favorited", "videos_count": "user.aweme_count",
    },
    "xhs_note": {
        "note_id": "note_id", "type": "type", "title": "title", "desc": "desc", "time": "time", "last_update_time": "last_update_time", "user_id": "user.user_id", "nickname": "user.nickname", "avatar": "user.avatar",
        "liked_count": "interact_info.liked_count", "collected_count": "interact_info.collected_count", "comment_count": "interact_info.comment_count", "share_count": "interact_info.share_count",
        "ip_location": "ip_location", "xsec_token": "xsec_token",
    },
    "xhs_note_comment": {
        "comment_id": "id", "create_time": "create_time", "ip_location": "ip_location", "content": "content", "user_id": "user_info.user_id", "nickname": "user_info.nickname", "avatar": "user_info.image",
        "sub_comment_count": "sub_comment_count", "parent_comment_id": "target_comment.id", "like_count": "like_count",
    },
    "xhs_creator": {"nickname": "basicInfo.nickname", "gender": "basicInfo.gender", "avatar": "basicInfo.images", "desc": "basicInfo.desc", "ip_location": "basicInfo.ipLocation"},
    "kuaishou_video": {
        "video_id": "photo.id", "video_type": "type", "title": "photo.caption", "desc": "photo.caption", "create_time": "photo.timestamp", "user_id": "author.id", "nickname": "author.name", "avatar": "author.headerUrl",
        "liked_count": "photo.realLikeCount", "viewd_count": "photo.viewCount", "video_cover_url": "photo.coverUrl", "video_play_url": "photo.photoUrl",
    },
    "kuaishou_video_comment": {
        "comment_id": "comment_id|commentId", "create_time": "timestamp", "content": "content", "user_id": "author_id|authorId", "nickname": "author_name|authorName", "avatar": "headurl",
        "sub_comment_count": "commentCount|subCommentCount",
    },
    "kuaishou_creator": {"nickname": "profile.user_name", "gender": "profile.gender", "avatar": "profile.headurl", "desc": "profile.user_text", "follows": "ownerCount.follow", "fans": "ownerCount.fan", "interaction": "ownerCount.photo_public"},
    "weibo_note": {
        "note_id": "mblog.id", "content": "mblog.text", "created_at": "mblog.created_at", "liked_count": "mblog.attitudes_count", "comments_count": "mblog.comments_count", "shared_count": "mblog.reposts_count",
        "ip_location": "mblog.region_name", "user_id": "mblog.user.id", "nickname": "mblog.user.screen_name", "gender": "mblog.user.gender", "profile_url": "mblog.user.profile_url", "avatar": "mblog.user.profile_image_url",
    },
    "weibo_note_comment": {
        "comment_id": "id", "content": "text", "created_at": "created_at", "sub_comment_count": "total_number", "comment_like_count": "like_count", "ip_location": "source", "parent_comment_id": "rootid",
        "user_id": "user.id", "nickname": "user.screen_name", "gender": "user.gender", "profile_url": "user.profile_url", "avatar": "user.profile_image_url",
    },
    "weibo_creator": {"nickname": "screen_name", "gender": "gender", "avatar": "avatar_hd", "desc": "description", "ip_location": "source", "follows": "follow_count", "fans": "followers_count"},
    "zhihu_content": {
        "content_id": "id", "content_type": "type", "content_text": "content", "question_id": "question.id", "title": "title", "desc": "description|excerpt", "created_time": "created_time|created|published_at|created_at",
        "updated_time": "updated_time|updated|updated_at", "voteup_count": "voteup_count", "comment_count": "comment_count", "video_url": "video_url",
        "user_id": "author.id|author.member.id", "user_nickname": "author.name|author.member.name", "user_avatar": "author.avatar_url|author.member.avatar_url", "user_url_token": "author.url_token|author.member.url_token",
    },
    "zhihu_comment": {
        "comment_id": "id", "parent_comment_id": "reply_comment_id", "content": "content", "publish_time": "created_time", "sub_comment_count": "child_comment_count", "like_count": "like_count", "dislike_count": "dislike_count",
        "user_id": "author.id|author.member.id", "user_nickname": "author.name|author.member.name", "user_avatar": "author.avatar_url|author.member.avatar_url", "url_token": "author.url_token|author.member.url_token",
    },
    "zhihu_creator": {
        "user_id": "id", "user_nickname": "name", "user_avatar": "avatarUrl", "url_token": "urlToken", "gender": "gender", "ip_location": "ipInfo", "follows": "followingCount", "fans": "followerCount", "anwser_count": "answerCount",
        "video_count": "zvideoCount", "question_count": "questionCount", "article_count": "articlesCount", "column_count": "columnsCount", "get_voteup_count": "voteupCount",
    },
}

# fixed values: what each platform's gender codes mean; null and unknown codes stay null
GENDERS = {"douyin": {"1": "Male", "2": "Female", "0": "Unknown"}, "xhs": {"1": "Female", "0": "Male"}, "zhihu": {"1": "Male", "0": "Female"}, "weibo": {"f": "Female", "m": "Male"}, "kuaishou": {"F": "Female", "M": "Male"}}


def parse(raw: DataFrame) -> DataFrame:
    """raw with v, the payload as VARIANT; broken payloads give null columns."""
    return raw.withColumn("v", F.try_parse_json("payload"))


def at(path: str, kind: str = "string", of: str = "v") -> Column:
    """A place in the record; of several, the first that is neither null nor empty."""
    found = [F.try_variant_get(of, f"$.{p}", kind) for p in path.split("|")]
    return found[0] if len(found) == 1 else F.coalesce(*(F.nullif(x, F.lit("")) if kind == "string" else x for x in found))


def gender(platform: str, code: Column) -> Column:
    return F.coalesce(*(F.when(code == k, v) for k, v in GENDERS[platform].items()))


def _flat(raw: DataFrame, name: str, extra: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    columns = {c: at(p) for c, p in PATHS[name].items()}
    columns |= extra or {}
    also = [c for c in ("source_keyword",) if c in raw.columns]
    return parse(raw).select(*keep, *(v.alias(c) for c, v in columns.items()), *also, F.col("modified").alias("last_modify_ts"))


def _urls(path: str) -> Column:
    return at(path, "array<string>")


def bilibili_videos(raw: DataFrame) -> DataFrame:
    cut = {c: F.substring(F.coalesce(at(PATHS["bilibili_video"][c]), F.lit("")), 1, 500) for c in ("title", "desc")}
    return _flat(raw, "bilibili_video", cut | {"video_type": F.lit("video"), "video_url": F.concat(F.lit("https://www.bilibili.com/video/av"), at("View.aid"))}).where("video_id is not null")


def bilibili_creators(raw: DataFrame) -> DataFrame:
    return _flat(raw, "bilibili_up_info").where("user_id is not null")


def bilibili_comments(raw: DataFrame) -> DataFrame:
    zero = {c: F.coalesce(at(PATHS["bilibili_video_comment"][c]), F.lit("0")) for c in ("parent_comment_id", "sub_comment_count", "like_count")}
    return _flat(raw, "bilibili_video_comment", zero | {"video_id": F.col("post_id").cast("string")})


def bilibili_contacts(fans: DataFrame, followings: DataFrame) -> DataFrame:
    """Edges up -> fan from contact records and their creator (creator_id, creator_name): fans of it, and whom it follows."""
    own = {"id": F.col("creator_id").cast("string"), "name": F.col("creator_name")}

    def edges(raw: DataFrame, up_is_creator: bool) -> DataFrame:
        other = {c: at(PATHS["bilibili_contact"][c]) for c in ("id", "name")}
        up, fan = (own, other) if up_is_creator else (other, own)
        return parse(raw).select(*(up[c].alias(f"up_{c}") for c in up), *(fan[c].alias(f"fan_{c}") for c in fan), F.col("modified").alias("last_modify_ts"))

    return edges(fans, True).unionByName(edges(followings, False))


def bilibili_dynamics(raw: DataFrame) -> DataFrame:
    kind = F.element_at(F.split(at("type"), "_"), -1)
    return _flat(raw, "bilibili_up_dynamic", {"type": kind, "text": F.coalesce(at("modules.module_dynamic.desc.text"), F.lit("")), "user_id": F.col("creator_id").cast("string"), "user_name": F.col("creator_name")})


def douyin_posts(raw: DataFrame) -> DataFrame:
    """Posts of search rows too: the record itself, or the first of a mix."""
    lists = [_urls(f"video.{x}.url_list") for x in ("play_addr_h264", "play_addr_256", "play_addr")]
    chosen = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))
    images = at("images", "array<struct<url_list:array<string>>>")
    extra = {
        "aweme_url": F.concat(F.lit("https://www.douyin.com/video/"), at("aweme_id")),
        "cover_url": F.coalesce(at(PATHS["douyin_aweme"]["cover_url"]), F.lit("")),
        "video_download_url": F.coalesce(F.when(F.size(chosen) >= 2, F.element_at(chosen, -1)), F.lit("")),
        "note_download_url": F.coalesce(F.array_join(F.transform(F.filter(images, lambda i: F.size(i["url_list"]) > 0), lambda i: F.element_at(i["url_list"], -1)), ","), F.lit("")),
    }
    inner = F.coalesce(F.get_json_object("payload", "$.aweme_info"), F.get_json_object("payload", "$.aweme_mix_info.mix_items[0]"), F.col("payload"))
    return _flat(raw.withColumn("payload", inner), "douyin_aweme", extra).where("aweme_id is not null")


def douyin_comments(raw: DataFrame) -> DataFrame:
    """Comments of their own post only."""
    pictures = at("image_list", "array<struct<origin_url:struct<url_list:array<string>>>>")
    second = F.transform(F.filter(pictures, lambda p: F.size(p["origin_url"]["url_list"]) > 1), lambda p: F.get(p["origin_url"]["url_list"], F.lit(1)))
    extra = {"like_count": F.coalesce(at("digg_count"), F.lit("0")), "sub_comment_count": F.coalesce(at("reply_comment_total"), F.lit("0")), "parent_comment_id": F.coalesce(at("reply_id"), F.lit("0")), "pictures": F.coalesce(F.array_join(second, ","), F.lit(""))}
    return _flat(raw, "douyin_aweme_comment", extra, ("post_id",)).where(F.col("aweme_id") == F.col("post_id").cast("string")).drop("post_id")


def douyin_creators(raw: DataFrame) -> DataFrame:
    return _flat(raw, "dy_creator", {"gender": F.coalesce(gender("douyin", at("user.gender")), F.lit("Unknown")), "avatar": F.concat(F.lit("https://p3-pc.douyinpic.com/img/"), at("user.avatar_300x300.uri"), F.lit("~c5_300x300.jpeg?from=2956013662"))}, ("user_id",))


def xhs_notes(raw: DataFrame) -> DataFrame:
    images = at("image_list", "array<struct<url:string,url_default:string>>")
    tags = at("tag_list", "array<struct<name:string,type:string>>")
    key = at("video.consumer.origin_video_key|video.consumer.originVideoKey")
    streams = at("video.media.stream.h264", "array<struct<master_url:string>>")
    video = F.when(key.isNotNull(), F.concat(F.lit("http://sns-video-bd.xhscdn.com/"), key)).otherwise(F.array_join(F.transform(streams, lambda s: s["master_url"]), ","))
    extra = {
        "title": F.coalesce(F.nullif(at("title"), F.lit("")), F.substring(F.coalesce(at("desc"), F.lit("")), 1, 255)),
        "last_update_time": F.coalesce(at("last_update_time"), F.lit("0")),
        "video_url": F.coalesce(F.when(at("type") == "video", video), F.lit("")),
        "image_list": F.coalesce(F.array_join(F.transform(images, lambda i: F.coalesce(F.nullif(i["url_default"], F.lit("")), i["url"], F.lit(""))), ","), F.lit("")),
        "tag_list": F.coalesce(F.array_join(F.transform(F.filter(tags, lambda g: g["type"] == "topic"), lambda g: F.coalesce(g["name"], F.lit(""))), ","), F.lit("")),
        "note_url": F.concat(F.lit("https://www.xiaohongshu.com/explore/"), at("note_id"), F.lit("?xsec_token="), F.coalesce(at("xsec_token"), F.lit("")), F.lit("&xsec_source=pc_search")),
    }
    return _flat(raw, "xhs_note", extra).where("note_id is not null")


def xhs_comments(raw: DataFrame) -> DataFrame:
    pictures = F.transform(at("pictures", "array<struct<url_default:string>>"), lambda p: F.coalesce(p["url_default"], F.lit("")))
    zero = {c: F.coalesce(at(PATHS["xhs_note_comment"][c]), F.lit("0")) for c in ("sub_comment_count", "parent_comment_id", "like_count")}
    return _flat(raw, "xhs_note_comment", zero | {"note_id": F.col("post_id").cast("string"), "pictures": F.coalesce(F.array_join(pictures, ","), F.lit(""))})


def xhs_creators(raw: DataFrame) -> DataFrame:
    """Creators with their counts and tags as a JSON object; of repeated types the last entry counts, at the place of the
    first, and entries without a type are left out."""
    counts = F.reverse(at("interactions", "array<struct<type:string,count:string>>"))
    tags = F.filter(at("tags", "array<struct<tagType:string,name:string>>"), lambda g: g["tagType"].isNotNull())
    kinds = F.array_distinct(F.transform(tags, lambda g: g["tagType"]))
    names = F.transform(kinds, lambda k: F.element_at(F.filter(tags, lambda g: g["tagType"] == k), -1)["name"])
    extra = {c: F.coalesce(F.get(F.filter(counts, lambda i: i["type"] == c), F.lit(0))["count"], F.lit("0")) for c in ("follows", "fans", "interaction")}  # noqa: B023
    return _flat(raw, "xhs_creator", extra | {"gender": gender("xhs", at("basicInfo.gender")), "tag_list": F.coalesce(F.to_json(F.map_from_arrays(kinds, names)), F.lit("{}"))}, ("user_id",))


def kuaishou_videos(raw: DataFrame) -> DataFrame:
    cut = {c: F.substring(F.coalesce(at("photo.caption"), F.lit("")), 1, 500) for c in ("title", "desc")}
    return _flat(raw, "kuaishou_video", cut | {"video_url": F.concat(F.lit("https://www.kuaishou.com/short-video/"), at("photo.id"))}).where("coalesce(video_id, '') != ''")


def kuaishou_comments(raw: DataFrame) -> DataFrame:
    return _flat(raw, "kuaishou_video_comment", {"video_id": F.col("post_id").cast("string"), "sub_comment_count": F.coalesce(at(PATHS["kuaishou_video_comment"]["sub_comment_count"]), F.lit("0"))})


def kuaishou_creators(raw: DataFrame) -> DataFrame:
    return _flat(raw, "kuaishou_creator", {"gender": gender("kuaishou", at("profile.gender")), "ip_location": F.lit("")}, ("user_id",))


def weibo_cards(raw: DataFrame) -> DataFrame:
    """Posts among search cards: cards of type 9, at the top and in groups."""
    own = raw.where(F.get_json_object("payload", "$.card_type") == "9")
    group = raw.withColumn("payload", F.explode(F.from_json(F.get_json_object("payload", "$.card_group"), "array<string>"))).where(F.get_json_object("payload", "$.card_type") == "9")
    return own.unionByName(group)


def _weibo(raw: DataFrame, name: str, text: str, created: str, place: Column, extra: dict[str, Column]) -> DataFrame:
    when = from_rfc2822(at(created))
    local = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(when, F.current_timezone()), "+08:00"), "yyyy-MM-dd HH:mm:ss")
    extra |= {"content": F.regexp_replace(at(text), "<.*?>", ""), "create_time": F.unix_timestamp(when), "create_date_time": F.concat(local, F.lit("+08:00")), "ip_location": place}
    return _flat(raw, name, extra).drop("created_at")


def weibo_notes(raw: DataFrame) -> DataFrame:
    place = F.replace(F.coalesce(at("mblog.region_name"), F.lit("")), F.lit("发布于 "), F.lit(""))
    return _weibo(raw, "weibo_note", "mblog.text", "mblog.created_at", place, {"note_url": F.concat(F.lit("https://m.weibo.cn/detail/"), at("mblog.id"))}).where("note_id is not null")


def weibo_comments(raw: DataFrame) -> DataFrame:
    place = F.replace(F.coalesce(at("source"), F.lit("")), F.lit("来自"), F.lit(""))
    return _weibo(raw, "weibo_note_comment", "text", "created_at", place, {"note_id": F.col("post_id").cast("string")})


def weibo_creators(raw: DataFrame) -> DataFrame:
    return _flat(raw, "weibo_creator", {"gender": gender("weibo", at("gender")), "ip_location": F.replace(F.coalesce(at("source"), F.lit("")), F.lit("来自"), F.lit("")), "tag_list": F.lit("")}, ("user_id",))


def overlay_long_text(posts: DataFrame, details: DataFrame, key: str = "note_id", column: str = "content") -> DataFrame:
    """posts with the full text of those that details has; the others keep their short one."""
    full = details.select(key, F.col(column).alias("__full"))
    return posts.join(full, key, "left").withColumn(column, F.coalesce("__full", column)).drop("__full")


def nested_comments(raw: DataFrame, path: str = "comments") -> DataFrame:
    """Comment records and the replies inside them, one level, with the same post_id."""
    inner = raw.withColumn("payload", F.explode(F.from_json(F.get_json_object("payload", f"$.{path}"), "array<string>")))
    return raw.unionByName(inner)


def zhihu_contents(raw: DataFrame) -> DataFrame:
    """Answers, articles and videos; other types are left out. A video's address is built from its id."""
    clean = {c: t.html_text(at(PATHS["zhihu_content"][c])) for c in ("content_text", "title", "desc")}
    kind, key = at("type"), at("id")
    in_list = F.try_variant_get("v", "$.video.video_id", "string").isNotNull() | at("video_url").isNull()
    url = (
        F.when(kind == "answer", F.concat(F.lit("https://www.zhihu.com/question/"), at("question.id"), F.lit("/answer/"), key))
        .when(kind == "article", F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), key))
        .when(in_list, F.concat(F.lit("https://www.zhihu.com/zvideo/"), key))
        .otherwise(at("video_url"))
    )
    extra = clean | {"content_url": url, "user_link": F.concat(F.lit("https://www.zhihu.com/people/"), at(PATHS["zhihu_content"]["user_url_token"]))}
    return _flat(raw, "zhihu_content", extra).where(F.col("content_type").isin("answer", "article", "zvideo")).drop("video_url")


def zhihu_comments(raw: DataFrame) -> DataFrame:
    tags = F.filter(at("comment_tag", "array<struct<type:string,text:string>>"), lambda g: g["type"] == "ip_info")
    extra = {
        "content": t.html_text(at("content")), "ip_location": F.coalesce(F.get(tags, F.lit(0))["text"], F.lit("")), "like_count": F.coalesce(at("like_count"), F.lit("0")), "dislike_count": F.coalesce(at("dislike_count"), F.lit("0")),
        "content_id": F.col("post_id").cast("string"), "user_link": F.concat(F.lit("https://www.zhihu.com/people/"), at(PATHS["zhihu_comment"]["url_token"])), "type": at("type"),
    }
    return _flat(raw, "zhihu_comment", extra).where("type = 'comment'").drop("type", "url_token")


def zhihu_creators(raw: DataFrame) -> DataFrame:
    return _flat(raw, "zhihu_creator", {"gender": F.coalesce(gender("zhihu", at("gender")), F.lit("Unknown")), "user_link": F.concat(F.lit("https://www.zhihu.com/people/"), at("urlToken"))})


# fixed values: columns of the platform tables that a unified source takes: id, title, body, creator, url, thumbnail, time, metrics
SOURCES = {
    "bilibili": ("video_id", ("title", "desc"), ("desc", "title"), "nickname", "video_url", "https://www.bilibili.com/video/av", "video_cover_url", "create_time", {"likes": "liked_count", "views": "video_play_count", "comments": "video_comment", "shares": "video_share_count", "coins": "video_coin_count"}),
    "douyin": ("aweme_id", ("title", "desc"), ("desc",), "nickname", "aweme_url", "https://www.douyin.com/video/", "cover_url", "create_time", {"likes": "liked_count", "comments": "comment_count", "shares": "share_count"}),
    "xiaohongshu": ("note_id", ("title", "desc"), ("desc", "title"), "nickname", "note_url", "https://www.xiaohongshu.com/explore/", "image_list", "time", {"likes": "liked_count", "comments": "comment_count", "shares": "share_count", "collects": "collected_count", "media_type": "type", "video_url": "video_url"}),
    "zhihu": ("content_id", ("title", "desc"), ("content_text", "desc"), "user_nickname", "content_url", "", "user_avatar", "created_time", {"upvotes": "voteup_count", "comments": "comment_count", "content_type": "content_type"}),
    "kuaishou": ("video_id", ("title", "desc"), ("desc", "title"), "nickname", "video_url", "https://www.kuaishou.com/short-video/", "video_cover_url", "create_time", {"likes": "liked_count", "plays": "viewd_count"}),
    "weibo": ("note_id", ("content",), ("content",), "nickname", "note_url", "https://weibo.com/detail/", "avatar", "create_time", {"likes": "liked_count", "comments": "comments_count", "shares": "shared_count"}),
}
SPOKEN = ("xiaohongshu", "zhihu", "weibo")  # platforms whose body is the source's full text


def to_source(rows: DataFrame, platform: str, comments: DataFrame | None = None, comment_limit: int = 4) -> DataFrame:
    """One platform table as sources: platform, object_id, title, creator, url, thumbnail, published, summary (300
    characters of body and first comments), transcript, transcript_preview (420), metrics (map without nulls) and
    comments. comments: object_id, pos, text."""
    key, titles, bodies, creator, url, base, thumb, time, metrics = SOURCES[platform]
    body = t.strip_html(t.first_nonempty(*bodies))
    rows = rows.withColumn("object_id", F.col(key).cast("string"))
    if comments is not None:
        first = comments.withColumnRenamed("object_id", "source_id")
        from .collect import first_comments

        rows = rows.join(first_comments(first, comment_limit).withColumnRenamed("source_id", "object_id"), "object_id", "left")
    said = F.coalesce(F.col("comments"), F.array().cast("array<string>")) if comments is not None else F.array().cast("array<string>")
    title = t.strip_html(t.first_nonempty(*titles, default="Untitled"))
    if platform == "weibo":
        title = F.coalesce(F.nullif(F.substring(body, 1, 48), F.lit("")), F.lit("Untitled"))
    pairs = F.map_filter(F.create_map(*(x for name, c in metrics.items() for x in (F.lit(name), F.nullif(F.nullif(F.col(c).cast("string"), F.lit("None")), F.lit(""))))), lambda _, v: v.isNotNull())
    text = F.when(F.lit(platform in SPOKEN), body).otherwise(F.lit(""))
    made = F.concat(F.lit(base), F.col("object_id")) if base else F.lit("")
    return rows.select(
        F.lit(platform).alias("platform"), "object_id", title.alias("title"), t.first_nonempty(creator).alias("creator"), F.coalesce(F.nullif(t.first_nonempty(url), F.lit("")), made).alias("url"),
        F.get(F.split(t.first_nonempty(thumb), ","), F.lit(0)).alias("thumbnail"), t.first_nonempty(time).alias("published"),
        F.substring(t.squeeze(F.array_join(F.filter(F.concat(F.array(body), said), lambda x: x != ""), " ")), 1, 300).alias("summary"),
        text.alias("transcript"), F.substring(text, 1, 420).alias("transcript_preview"), pairs.alias("metrics"), said.alias("comments"),
    )


def all_sources(tables: dict[str, DataFrame], comments: dict[str, DataFrame] | None = None) -> DataFrame:
    """The given platform tables as one table of sources."""
    out = None
    for platform, rows in tables.items():
        one = to_source(rows, platform, (comments or {}).get(platform))
        out = one if out is None else out.unionByName(one)
    return out
