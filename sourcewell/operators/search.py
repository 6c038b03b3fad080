"""Search results, detail pages and page data as sources: rows of JSON texts in many forms, read by path expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .collect import top_by

# fixed values: rows that recommend another search, picture sizes from large to small, orders of search results
RECOMMENDED = ("rec_query", "hot_query")
SIZES = ("maxres", "standard", "high", "medium", "default")
ORDERS = {
    "general": (), "popularity": (("likes", True), ("n_comments", True)), "latest": (("published", True),), "most_likes": (("likes", True),),
    "upvotes": (("likes", True),), "most_comments": (("n_comments", True),), "most_plays": (("views", True),),
}
MEDIA_KINDS = {"all": None, "video": ("video", "zvideo"), "image": ("normal", "image"), "answer": ("answer",), "article": ("article",), "zvideo": ("zvideo",)}

UNTITLED = "Untitled"
_STRING = r'"(?:[^"\\]|\\.)*+"'


def _get(row: str | Column, *paths: str, default: str = "") -> Column:
    """The first value of a JSON row's paths that isn't blank."""
    return t.first_nonempty(*(F.get_json_object(t.c(row), f"$.{p}") for p in paths), default=default)


def _or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def thumbnail(row: str | Column, at: str = "thumbnails") -> Column:
    """The largest picture that has an address; empty if none has."""
    return _get(row, *(f"{at}.{size}.url" for size in SIZES))


def comment_rows(rows: DataFrame) -> DataFrame:
    """source_id, pos, author, text, likes, time of comments (source_id, pos, row: JSON), of any of the known spellings."""
    return rows.select(
        "source_id", "pos", _get("row", "author", "user", "nickname", "name").alias("author"), t.strip_html(_get("row", "text", "content", "message", "comment")).alias("text"),
        t.first_number(_get("row", "likes", "like_count", "likeCount")).alias("likes"), _get("row", "time", "date", "published").alias("time"),
    )


def api_threads(rows: DataFrame) -> DataFrame:
    """source_id, pos, author, text, likes, time of nested comment threads (source_id, pos, row: JSON of the API)."""
    at = "snippet.topLevelComment.snippet."
    return rows.select(
        "source_id", "pos", _get("row", at + "authorDisplayName").alias("author"), t.strip_html(_get("row", at + "textDisplay", at + "textOriginal")).alias("text"),
        t.first_number(_get("row", at + "likeCount")).alias("likes"), _get("row", at + "publishedAt").alias("time"),
    ).where("text != ''")


def search_sources(rows: DataFrame) -> DataFrame:
    """Search results (platform: youtube or bilibili, pos, row: JSON) as sources: platform, pos, object_id, url, title,
    creator, thumbnail, duration, published, views, summary. Addresses are built from ids where they are missing."""
    tube = F.col("platform") == "youtube"
    pick = lambda yes, no: F.when(tube, _get("row", *yes)).otherwise(_get("row", *no))
    out = rows.select(
        "platform", "pos", pick(("videoId", "id"), ("bvid", "bvId", "id")).alias("object_id"), _get("row", "url", "href", "link").alias("given"),
        t.strip_html(_get("row", "title", "name", default=UNTITLED)).alias("title"), pick(("channel", "channelName", "author", "creator"), ("author", "up", "owner", "creator")).alias("creator"),
        pick(("thumbnail", "thumbnailUrl", "thumb"), ("thumbnail", "pic", "cover")).alias("thumbnail"), _get("row", "duration", "length").alias("duration"),
        pick(("published", "publishedTime", "date"), ("published", "pubdate", "date")).alias("published"), t.first_number(pick(("views", "viewCount"), ("views", "play", "view"))).alias("views"),
    )
    built = F.when(tube & (F.col("object_id") != ""), F.concat(F.lit("https://www.youtube.com/watch?v="), "object_id")).when(F.col("object_id").startswith("BV"), F.concat(F.lit("https://www.bilibili.com/video/"), "object_id")).otherwise("")
    return out.withColumn("url", F.when(F.col("given") != "", F.col("given")).otherwise(built)).withColumn("summary", F.col("title")).drop("given")


def playlist_sources(rows: DataFrame) -> DataFrame:
    """Flat playlist entries (pos, row: JSON) as sources of search_sources()' columns."""
    given = _get("row", "id", "url")
    url = F.when(given == "", "").when(given.startswith("http"), given).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), given))
    title = t.strip_html(_get("row", "title", default=UNTITLED))
    return rows.select(
        F.lit("youtube").alias("platform"), "pos", _get("row", "id").alias("object_id"), title.alias("title"), _get("row", "uploader", "channel").alias("creator"), _get("row", "thumbnail").alias("thumbnail"),
        _get("row", "duration_string").alias("duration"), F.lit("").alias("published"), F.lit(None).cast("long").alias("views"), url.alias("url"), title.alias("summary"),
    )


def api_sources(found: DataFrame, details: DataFrame) -> DataFrame:
    """API search results (pos, row: JSON) with their details (row: JSON) joined by id, in the results' order; what the
    details lack is taken from the result."""
    ids = found.select("pos", F.col("row").alias("hit"), _get("row", "id.videoId").alias("object_id")).where("object_id != ''")
    known = details.select(_get("row", "id").alias("object_id"), F.col("row").alias("detail")).dropDuplicates(["object_id"])
    rows = ids.join(known, "object_id", "left")
    both = lambda path: F.coalesce(_or_null(_get("detail", path)), _get("hit", path))
    title = t.strip_html(F.coalesce(_or_null(both("snippet.title")), F.lit(UNTITLED)))
    number = lambda path: t.first_number(_get("detail", path))
    return rows.select(
        F.lit("youtube").alias("platform"), "pos", "object_id", F.concat(F.lit("https://www.youtube.com/watch?v="), "object_id").alias("url"), title.alias("title"), both("snippet.channelTitle").alias("creator"),
        thumbnail("detail", "snippet.thumbnails").alias("thumbnail"), _get("detail", "contentDetails.duration").alias("duration"), both("snippet.publishedAt").alias("published"),
        number("statistics.viewCount").alias("views"), number("statistics.likeCount").alias("likes"), number("statistics.commentCount").alias("n_comments"),
        t.excerpt([title, t.strip_html(both("snippet.description"))], 300).alias("summary"),
    )


def metrics_text(metrics: str | Column) -> Column:
    """A map of metrics as 'name: value' parts by name, empty ones left out."""
    kept = F.filter(F.array_sort(F.map_entries(t.c(metrics))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")


def cli_items(rows: DataFrame) -> DataFrame:
    """Crawled rows (platform, row: JSON) as items of a command-line search: platform, item_id, title, url, author,
    published, metrics (text). Titles fall back on 80 characters of the text."""
    title = t.strip_html(_get("row", "title", "desc", "content", "content_text"))
    kinds = {"views": ("video_play_count", "viewd_count", "view_count", "views"), "likes": ("liked_count", "like_count", "voteup_count", "likes"), "comments": ("comment_count", "comments_count", "video_comment"), "shares": ("share_count", "shared_count", "video_share_count")}
    metrics = F.map_from_arrays(t.words(kinds), F.array(*(_get("row", *paths) for paths in kinds.values())))
    return rows.select(
        "platform", _get("row", "video_id", "aweme_id", "note_id", "content_id", "id").alias("item_id"), F.when(F.length(title) > 80, F.concat(F.substring(title, 1, 80), F.lit("..."))).otherwise(F.coalesce(_or_null(title), F.lit(UNTITLED))).alias("title"),
        _get("row", "video_url", "aweme_url", "note_url", "content_url", "url").alias("url"), _get("row", "nickname", "user_nickname", "author").alias("author"), _get("row", "create_time", "created_time", "time").alias("published"), metrics_text(metrics).alias("metrics"),
    )


def with_details(found: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Search results with their details, all results kept, in their order (pos)."""
    return found.join(details, key, "left")


# ---- filters and orders ----------------------------------------------------------------------------------------------


def without_recommended(rows: DataFrame, column: str = "model_type") -> DataFrame:
    """Rows that are no recommendations of other searches; rows without a type stay."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*RECOMMENDED))


def of_kind(rows: DataFrame, kind: str = "all", column: str = "kind") -> DataFrame:
    """Rows of a media type; all of them for 'all'."""
    values = MEDIA_KINDS[kind]
    return rows if values is None else rows.where(F.col(column).isin(*values))


def search_order(rows: DataFrame, order: str, n: int, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The first n rows of each group in an order of the platforms' searches, with their rank; ties by source_id."""
    keys = [F.col(c).desc_nulls_last() if down else F.col(c) for c, down in ORDERS[order]]
    return top_by(rows, list(by), [*keys, F.col("source_id")], n)


def permitted_media(rows: DataFrame, remote: bool = True) -> DataFrame:
    """Media (value, rights_basis) that may be worked on: local ones, and remote ones with a declared basis if allowed."""
    far = F.lower(F.regexp_extract(F.coalesce("value", F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).isin("http", "https")
    return rows.where(~far | (F.lit(remote) & (F.coalesce("rights_basis", F.lit("")) != "")))


def with_url(sources: DataFrame) -> DataFrame:
    return sources.where(F.coalesce("url", F.lit("")) != "")


def detailed_first(sources: DataFrame, details: int, cap: int = 50) -> DataFrame:
    """At most cap sources of a run by source_id, with enrich: true for the first ones of each platform."""
    kept = top_by(sources, ["run_id"], [F.col("source_id")], cap, "position")
    return top_by(kept, ["run_id", "platform"], [F.col("position")], cap, "nth").withColumn("enrich", F.col("nth") <= details).drop("nth")


def faceted(sources: DataFrame, platform: str = "all", cover: bool | None = None) -> DataFrame:
    """Sources of a platform, with or without a cover, or all."""
    rows = sources if platform == "all" else sources.where(F.col("platform") == platform)
    has = F.coalesce("cover", F.lit("")) != ""
    return rows if cover is None else rows.where(has if cover else ~has)


# ---- page data -------------------------------------------------------------------------------------------------------


def embedded(html: str | Column, pattern: str, bare: str = '""') -> Column:
    """The JSON that a pattern's first group finds in a page, over any number of lines, `undefined` values as `bare`
    (never inside strings); null if it doesn't parse."""
    raw = F.regexp_extract(F.coalesce(t.c(html), F.lit("")), f"(?s){pattern}", 1)
    # Strings are kept whole by marking what follows them; a mark that is left stands for the bare word.
    marked = F.regexp_replace(raw, rf"({_STRING})|\bundefined\b", "$1\u0000")
    fixed = F.replace(F.regexp_replace(marked, f"({_STRING})\u0000", "$1"), F.lit("\u0000"), F.lit(bare))
    return F.when((fixed != "") & F.try_parse_json(fixed).isNotNull(), fixed)


def page_notes(pages: DataFrame) -> DataFrame:
    """page_id, note_id, title, description, author, likes of the notes in pages' `__INITIAL_STATE__`."""
    state = embedded("html", r"window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*</script>")
    notes = F.from_json(F.get_json_object("state", "$.note.noteDetailMap"), "map<string,string>")
    rows = pages.select("page_id", state.alias("state")).select("page_id", F.explode(notes).alias("note_id", "row"))
    return rows.select("page_id", "note_id", _get("row", "note.title").alias("title"), _get("row", "note.desc").alias("description"), _get("row", "note.user.nickname").alias("author"), t.first_number(_get("row", "note.interactInfo.likedCount")).alias("likes"))


def page_creators(pages: DataFrame) -> DataFrame:
    """page_id, nickname, description of the creators in pages' `__INITIAL_STATE__`."""
    state = embedded("html", r"window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*</script>")
    rows = pages.select("page_id", F.get_json_object(state, "$.user.userPageData").alias("row")).where("row is not null")
    return rows.select("page_id", _get("row", "basicInfo.nickname").alias("nickname"), _get("row", "basicInfo.desc").alias("description"))


def page_entities(pages: DataFrame) -> DataFrame:
    """page_id, kind (answers, articles, zvideos, users), entity_id, title, content, author of the entities in pages'
    `js-initialData`; an author told by key only is looked up among the page's users."""
    data = embedded("html", r'<script[^>]*id="js-initialData"[^>]*>(\{.*?\})</script>')
    base = pages.select("page_id", F.get_json_object(data, "$.initialState.entities").alias("entities")).where("entities is not null")
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.from_json(F.get_json_object("entities", f"$.{n}"), "map<string,string>").alias("rows")) for n in ("answers", "articles", "zvideos", "users"))))
    rows = base.select("page_id", F.from_json(F.get_json_object("entities", "$.users"), "map<string,string>").alias("users"), kinds.alias("k")).select("page_id", "users", "k.kind", F.explode("k.rows").alias("entity_id", "row"))
    told = F.get_json_object("row", "$.author")
    user = F.when(F.ltrim(told).startswith("{"), told).otherwise(F.try_element_at("users", told))
    return rows.select(
        "page_id", "kind", "entity_id", _get("row", "title", "question.title", "name").alias("title"), t.strip_html(_get("row", "content", "description", "headline")).alias("content"),
        F.when(F.col("kind") == "users", _get("row", "name")).otherwise(t.first_nonempty(F.get_json_object(user, "$.name"))).alias("author"),
    )


def detail_notes(pages: DataFrame) -> DataFrame:
    """page_id, note_id, text, author, likes of the note in a detail page's `$render_data` array."""
    data = embedded("html", r"\$render_data\s*=\s*(\[.*?\])\s*\[0\]")
    rows = pages.select("page_id", F.get_json_object(data, "$[0].status").alias("row")).where("row is not null")
    return rows.select("page_id", _get("row", "id", "mid").alias("note_id"), t.strip_html(_get("row", "text")).alias("text"), _get("row", "user.screen_name").alias("author"), t.first_number(_get("row", "attitudes_count")).alias("likes"))
