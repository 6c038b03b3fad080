"""Main text of web pages by template deduction over the pages of a host.

A token is an opening tag or a text block together with the path of open elements above it. Its occurrence vector
says how often it is on each page of its host; tokens with equal vectors form an equivalence class. Vectors are never
gathered: each is an exclusive-or of hashes of (page, count), which Spark adds up in parts, so a host may have any
number of pages. Valid classes nest by their paths into the host's template. What is no template are the slots' data;
the slot with most of the host's unlinked text is the article's. Names of tags and classes only tell apart what the
template leaves open: comments or notices inside the article's slot, or pages where no slot stands out. A mark on an
element that holds the slot counts for nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, dealt_join, map_texts, maybe_in, stored

#: A text is template only with that many different pages of its host, and with one in SHARE of those that have the element
#: around it, which in turn one in GROUP of the host's pages has: then a host's template texts are at most SHARE * GROUP
#: times the mean number of texts on its pages, however many pages it has.
MIN_SUPPORT, SHARE, GROUP = 3, 3, 10
#: Templates of at most this size are broadcast.
BROADCAST_BYTES = 4 << 20

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<(?:[!?/])[^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MARKING = re.compile(r"(?i)class|id|role|itemprop|hidden")
_RAW_END = re.compile(r"</(script|style|noscript|template|svg|iframe|textarea|select|object|math|canvas|audio|video)\b[^>]*>?", re.I)
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "math", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "nav", "aside", "footer", "header"}
#: Elements whose place among their like siblings tells their role, as their names don't; later ones share the last.
_PLACED, _PLACES = {"div", "section", "table", "td"}, 16
# Elements, roles and words of class or id attributes that mark what is not the article. The latter two sets are weak: they
# are often on elements around a whole page, so an article below makes them void.
_APART = {"nav", "footer", "aside", "head", "button", "menu", "dialog"} | _RAW
_APART_WEAK = {"form", "fieldset"}
_APART_ROLES = {"navigation", "banner", "contentinfo", "search", "complementary", "dialog", "alert", "menu", "form"}
_APART_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "footer gdpr header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)


#: Words that may stand beside those in one name: "comments-list" marks, "has-comments", "no-sidebar", "header-fixed" don't.
_BESIDE = set("area bar block bottom box button buttons container global inner item items left link links list main outer page primary right secondary section site top wrap wrapper".split())


class _Open:
    """An open element. apart: depth of the innermost marked element that it is or stands in, 0 if none; firm: whether one of
    those marks is strong; marks: the weakly marked ones, innermost last, that no article or main part below makes void."""

    __slots__ = ("tag", "path", "depth", "apart", "firm", "marks", "level", "linked")

    def __init__(self, tag: str, path: str, depth: int, apart: int, firm: bool, marks: tuple[str, ...], level: int, linked: bool):
        self.tag, self.path, self.depth, self.apart, self.firm, self.marks, self.level, self.linked = tag, path, depth, apart, firm, marks, level, linked


def _marks(name: str, within: bool) -> bool:
    """Whether a whole name of a class or id marks its element; headers and banners of an article are its own."""
    words = {w for w in re.split(r"[^a-z]+", name) if w}
    found = words & _APART_WORDS
    return bool(found - ({"header", "banner"} if within else set())) and not words - found - _BESIDE


def _element(tag: str, attributes: str, above: _Open, place: int) -> _Open:
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    role = found.get("role", "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    words = {w for name in names for w in re.split(r"[^a-z]+", name) if w}
    level = max(above.level, 2 if tag == "article" or "articlebody" in found.get("itemprop", "").lower() else 1 if tag == "main" or role == "main" else 0)
    firm = tag in _APART or role in _APART_ROLES or "hidden" in found or tag == "header" and not above.level
    weak = tag in _APART_WEAK or tag not in ("html", "body", "main") and any(_marks(name, above.level > 0) for name in names)
    label = tag + "".join(f".{w}" for w in sorted(words)[:4])
    label = (label if len(label) < 40 else f"{tag}.{xxhash.xxh32_hexdigest(label)}") + (f"#{place}" if place > 1 else "")
    path, depth = f"{above.path}>{label}", above.depth + 1
    path = path if len(path) < 2000 else f"#{xxhash.xxh64_hexdigest(path)}"
    marks = () if level > above.level else above.marks
    return _Open(tag, path, depth, depth if firm or weak else above.apart, above.firm or firm, (*marks, path) if weak else marks, level, above.linked or tag == "a")


_ROOT = _Open("", "", 0, 0, False, (), 0, False)
#: Elements opened lately, by the element above, tag, attributes and place among like siblings.
_known: dict[tuple[_Open, str, str, int], _Open] = {}


def parse(page: str) -> tuple[Counter, list[tuple[str, str, int, int, int, bool]]]:
    """Paths and levels of the opening tags with their counts, and the text blocks in order: text, path, depth of the innermost
    marked element around it (0: none), article level (2 article, 1 main part, 0 neither), characters outside links, and
    whether the marks alone set it apart. A weak mark around all that strong ones leave of a page is none.

    One pass over the page; broken, unclosed and cut-off markup is read as browsers do, roughly.
    """
    stack = [_ROOT]
    placed: list[dict] = [{}]  # of each open element, how many children of a kind it had
    opened: Counter = Counter()
    tags: Counter = Counter()
    blocks: list[tuple[str, str, int, int, int, bool, tuple[str, ...]]] = []
    parts: list[str] = []
    holder, unlinked = stack[0], 0

    def flush() -> None:
        nonlocal parts, unlinked
        if parts:
            text = "".join(parts) if len(parts) > 1 else parts[0]
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((text, holder.path, holder.apart, holder.level, min(unlinked, len(text)), holder.firm, holder.marks))
            parts, unlinked = [], 0

    def pop_to(names: set[str], barrier: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                for x in stack[k:]:
                    opened[x.tag] -= 1
                del stack[k:], placed[k:]
                return
            if stack[k].tag in barrier:
                return

    at, n = 0, len(page)
    while at < n:
        m, start = None, page.find("<", at)
        while start >= 0 and not (m := _TAG.match(page, start)):
            start = page.find("<", start + 1)
        text = page[at:start] if m else page[at:]
        if text:
            if not parts:
                holder = stack[-1]
                if holder.tag in _INLINE:
                    holder = next((x for x in reversed(stack) if x.tag not in _INLINE), _ROOT)
                if stack[-1].apart != holder.apart:
                    holder = stack[-1]
            parts.append(text)
            unlinked += 0 if stack[-1].linked else len(text)
        if not m:
            break
        at = m.end()
        quick, name, attributes, slash, other, rest = m.groups()
        if name:
            tag, closing, whole = name.lower(), quick, True
        elif other:
            tag, closing, attributes, whole = other.lower(), slash, rest, m[0].endswith(">")
        else:
            continue
        inline = tag in _INLINE
        if not inline:
            if parts:
                flush()
        elif tag == "br":
            parts.append(" ")
        if not whole:
            break
        if closing:
            if opened[tag]:
                if inline:
                    apart = stack[-1].apart
                    pop_to({tag}, _BARRIER)
                    if stack[-1].apart != apart:
                        flush()
                else:
                    pop_to({tag}, set())
            continue
        if not inline and opened["p"]:
            pop_to({"p"}, _BARRIER)
        if tag in _IMPLIED:
            pop_to(_IMPLIED[tag], {"ul", "ol", "dl", "table"})
        if attributes and not _MARKING.search(attributes):
            attributes = "/" if attributes.endswith("/") else ""
        place = 0
        if tag in _PLACED:
            place = placed[-1][tag, attributes] = min(placed[-1].get((tag, attributes), 0) + 1, _PLACES)
        key = (stack[-1], tag, attributes, place)
        new = _known.get(key)
        if new is None:
            if len(_known) > 50_000:
                _known.clear()
            new = _known[key] = _element(tag, attributes, stack[-1], place)
        if inline and new.apart != stack[-1].apart:
            flush()
        if not inline:
            tags[new.path, new.level] += 1
        if tag in _RAW and not attributes.endswith("/"):
            end = _RAW_END.search(page, at)
            while end and end[1].lower() != tag:
                end = _RAW_END.search(page, end.end())
            at = end.end() if end else n
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.append(new)
            placed.append({})
            opened[tag] += 1
    flush()
    around = [b[6] for b in blocks if not b[5]]
    void = 0
    while around and all(len(m) > void and m[void] == around[0][void] for m in around):
        void += 1
    return tags, [(*b[:5], b[5] or len(b[6]) > void) for b in blocks]


def host_of(url: str | None) -> str:
    """Lower-cased host of an address; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_PARSED = (
    "page_id long, url string, host string, tags array<struct<path:string,n:int,level:int>>, "
    "blocks array<struct<text:string,path:string,apart:int,lone:boolean,level:int,n:int,free:int>>"
)


def _parsed(rows: dict[str, list]) -> dict[str, list]:
    """Tags and blocks of each page; n, how often a block is on its page, and the characters outside links of all its
    occurrences are told at its first one."""
    out: dict[str, list] = {"page_id": rows["page_id"], "url": rows["url"], "host": [host_of(u) for u in rows["url"]], "tags": [], "blocks": []}
    for page in rows["html"]:
        tags, blocks = parse(page or "")
        counts, free = Counter((path, text) for text, path, *_ in blocks), Counter()
        for text, path, _, _, own, _ in blocks:
            free[path, text] += own
        out["tags"].append([{"path": path, "n": n, "level": level} for (path, level), n in tags.items()])
        found = []
        for text, path, apart, level, _, lone in blocks:
            n = counts.pop((path, text), 0)
            found.append({"text": text, "path": path, "apart": apart, "lone": lone, "level": level, "n": n, "free": free[path, text] if n else 0})
        out["blocks"].append(found)
    return out


def _token():
    return F.xxhash64("path", "text")


def _contents(parsed: DataFrame) -> DataFrame:
    """parsed without the pages whose host has a page of equal texts and tags already."""
    named = parsed.select(F.col("row").alias("doc_id"), "host", F.xxhash64("tags.path", "blocks.text").alias("content"))
    first = named.groupBy("host", "content").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    gone = stored(named.join(first, ["host", "content"]).where("doc_id != first").select("doc_id"))
    rows, bits = parsed.withColumnRenamed("row", "doc_id"), bitmap(gone)
    return maybe_in(rows, gone, bits, False).unionByName(maybe_in(rows, gone, bits).join(gone, "doc_id", "left_anti").select(*rows.columns))


def classes(parsed: DataFrame) -> DataFrame:
    """host, path, token (null for tags), pages, total (occurrences), level, free, all_pages and template of each token
    of parsed pages.

    Tokens of equal occurrence vectors are one class. With MIN_SUPPORT pages at least it is valid if it has a tag, so that
    markup comes and goes with its texts, on one in SHARE of the pages that have the element around its outermost tag;
    without a tag, on more than half of its host's pages. Texts of valid classes are template; so are tags on half of the
    pages, if the element that they stand in is, which nests the classes. What fewer pages have in common is their article's.
    """
    pages = _contents(parsed)
    root = pages.select("host", F.lit("").alias("path"), F.lit(None).cast("long").alias("token"), F.col("doc_id").alias("page"), F.lit(1).alias("n"), F.lit(0).alias("level"), F.lit(0).alias("free"))
    tags = pages.select("host", F.explode("tags").alias("t"), "doc_id").select("host", "t.path", F.lit(None).cast("long").alias("token"), F.col("doc_id").alias("page"), "t.n", "t.level", F.lit(0).alias("free"))
    texts = pages.select("host", F.explode("blocks").alias("b"), "doc_id").where("b.n > 0").select("host", "b.*", "doc_id").select("host", "path", _token().alias("token"), F.col("doc_id").alias("page"), "n", "level", "free")
    tokens = root.unionByName(tags).unionByName(texts).groupBy("host", "path", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.sum("n").alias("total"), F.max("level").alias("level"), F.sum("free").alias("free")
    )
    tokens = stored(tokens)
    all_pages = tokens.where("path = '' and token is null").select("host", F.col("pages").alias("all_pages"))
    several = tokens.where(F.col("pages") >= MIN_SUPPORT).groupBy("host", "vector", "pages").agg(F.bool_or(F.col("token").isNull()).alias("marked"), F.min(F.when(F.col("token").isNull(), F.struct(F.size(F.split("path", ">")).alias("depth"), "path")))["path"].alias("outer"))
    around = tokens.where("token is null").select("host", F.col("path").alias("above"), F.col("pages").alias("group"))
    several = several.withColumn("above", F.regexp_replace("outer", ">[^>]*$", "")).join(around, ["host", "above"], "left").drop("outer", "above")
    joined = tokens.join(several, ["host", "vector", "pages"], "left").join(all_pages, "host")
    half = F.col("pages") * 2 >= F.col("all_pages")
    group = F.coalesce("group", F.col("all_pages"))
    share = F.col("marked") & (F.col("pages") * SHARE >= group) & (group * GROUP >= F.col("all_pages"))
    template = F.when(F.col("token").isNull(), half).otherwise(F.col("marked").isNotNull() & (share | (F.col("pages") * 2 > F.col("all_pages"))))
    return joined.select("host", "path", "token", "pages", "total", "level", "free", "all_pages", template.alias("template"))


def templates(parsed: DataFrame) -> DataFrame:
    """host, tokens (hashes of template texts, null if none; SHARE bounds them) and container (null if none): the path of the
    element that holds the article. One row for every host.

    The container is the innermost element of the template that is there once, has other elements in it and holds
    more than half of the host's unlinked text outside the template; or the article element around that one.
    """
    found = stored(classes(parsed))
    texts = found.where(F.col("token").isNotNull() & F.col("template")).groupBy("host").agg(F.collect_list("token").alias("tokens"))
    parts = F.split("path", ">")
    above = F.expr("transform(sequence(1, size(parts)), i -> array_join(slice(parts, 1, i), '>'))")
    data = found.where(F.col("token").isNotNull() & ~F.col("template")).groupBy("host", "path").agg(F.sum("free").alias("free"))
    held = data.withColumn("parts", parts).select("host", F.explode(above).alias("path"), "free").groupBy("host", "path").agg(F.sum("free").alias("held"))
    tags = found.where(F.col("token").isNull()).select("host", "path", "level", (F.col("template") & (F.col("total") == F.col("pages"))).alias("once"), F.size(parts).alias("depth"))
    holders = tags.where("depth > 1").select("host", F.expr("array_join(slice(split(path, '>'), 1, depth - 1), '>')").alias("path")).distinct()
    elements = stored(tags.where("once").join(held, ["host", "path"]).join(holders, ["host", "path"], "left_semi"))
    whole = elements.where("path = ''").select("host", F.col("held").alias("whole"))
    inner = elements.join(whole, "host").where(F.col("held") * 2 > F.col("whole")).groupBy("host").agg(F.max_by("path", F.struct("depth", "path")).alias("inner"))
    # Elements of one host are few: those of its template.
    around = elements.where(F.col("level") == 2).join(inner, "host").where("inner = path or startswith(inner, concat(path, '>'))").groupBy("host").agg(F.min_by("path", "depth").alias("article"))
    container = inner.join(around, "host", "left").select("host", F.coalesce("article", "inner").alias("container"))
    hosts = found.where("path = '' and token is null").select("host")
    return stored(hosts.join(container, "host", "left").join(texts, "host", "left"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html).

    Of a page's blocks those of the template go, and what stands outside the container. Tags, roles and class names decide
    where that leaves a choice: blocks marked inside the container go, if others stay, and blocks of an article stay before
    others. A page with nothing in the container, or a host without one, is judged by the marks alone. A null, empty or
    text-free page gives an empty text; a null address belongs to the host of pages without one. Pages repeated on a host
    count as one content, so they don't turn their article into template. Pages of any length are read whole; other columns
    are not read; an empty table gives no rows.
    """
    parsed = stored(map_texts(pages.select("page_id", "url", "html"), _parsed, _PARSED, "html").withColumn("row", F.monotonically_increasing_id()))
    found = templates(parsed)
    size = found.agg(F.sum(100 + F.length("host") + F.coalesce(F.length("container"), F.lit(0)) + 8 * F.greatest(F.size("tokens"), F.lit(0)))).first()[0] or 0
    # Templates of so few hosts go to the pages; else pages and templates meet by host, a large host's in several tasks.
    rows = parsed.join(F.broadcast(found), "host") if size <= BROADCAST_BYTES else dealt_join(parsed, found, "host", "row")
    data = F.filter("blocks", lambda b: F.col("tokens").isNull() | ~F.array_contains("tokens", F.xxhash64(b["path"], b["text"])))
    rows = rows.select("page_id", "url", "container", data.alias("data"))
    inside = F.filter("data", lambda b: (b["path"] == F.col("container")) | b["path"].startswith(F.concat("container", F.lit(">"))))
    rows = rows.withColumn("inside", F.coalesce(inside, F.array())).withColumn("deep", F.size(F.split("container", ">")) - 1)
    rows = rows.withColumn("plain", F.filter("inside", lambda b: b["apart"] <= F.col("deep")))
    alone = F.filter("data", lambda b: ~b["lone"])
    rows = rows.withColumn("kept", F.when(F.size("plain") > 0, F.col("plain")).when(F.size("inside") > 0, F.col("inside")).otherwise(alone))
    best = F.array_max("kept.level")
    text = F.array_join(F.transform(F.filter("kept", lambda b: b["level"] == best), lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
