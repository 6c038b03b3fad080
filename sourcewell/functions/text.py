"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sql_text(x: str) -> str:
    """A string as a SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(values: Iterable[str]) -> Column:
    """An array literal."""
    return F.array(*(F.lit(v) for v in values))


def let(x: Column, f) -> Column:
    """f of a value that is worked out once, however often f's expression names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: str | Column) -> Column:
    """Without white space, Unicode's too, at both ends."""
    return F.regexp_replace(c(x), r"(?U)^\s+|\s+$", "")


def squeeze(x: str | Column) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(c(x), r"\s+", " ")


def first_nonempty(*values: str | Column, default: str = "") -> Column:
    """The first value that isn't null or blank, stripped."""
    return F.coalesce(*(F.nullif(strip(c(v).cast("string")), F.lit("")) for v in values), F.lit(default))


def strip_html(x: str | Column) -> Column:
    """Text without tags, white space squeezed."""
    return F.trim(squeeze(F.regexp_replace(F.coalesce(c(x), F.lit("")), "<[^>]+>", "")))


def html_text(x: str | Column) -> Column:
    """Text without tags, scripts and styles."""
    return strip_html(F.regexp_replace(F.coalesce(c(x), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", ""))


def excerpt(parts: list[str | Column], limit: int = 220) -> Column:
    """The parts that aren't blank, stripped, one blank apart, cut to limit characters."""
    kept = F.filter(F.array(*(strip(F.coalesce(c(p), F.lit(""))) for p in parts)), lambda p: p != "")
    return F.substring(squeeze(F.array_join(kept, " ")), 1, limit)


def tokens(x: str | Column) -> Column:
    """Latin tokens and runs of two or more CJK characters; long runs also give pairs from their first ten places."""
    found = F.regexp_extract_all(F.coalesce(c(x), F.lit("")), F.lit(rf"[A-Za-z0-9][A-Za-z0-9+\-_.]*|[{CJK}]{{2,}}"), F.lit(0))
    pairs = lambda t: F.when(F.regexp_like(t, F.lit(rf"^[{CJK}]{{5,}}$")), F.transform(F.sequence(F.lit(1), F.least(F.length(t) - 1, F.lit(10))), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(found, lambda t: F.concat(F.array(t), pairs(t))))


def terms(x: str | Column) -> Column:
    """The set of lower-cased Latin tokens, CJK pairs, and CJK characters that stand alone."""
    low = F.lower(F.coalesce(c(x), F.lit("")))
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9][a-z0-9+._-]*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(latin, F.flatten(pairs)))


def occurrences(x: str | Column, word: str | Column) -> Column:
    """How often a word occurs, without overlaps."""
    w = F.lit(word) if isinstance(word, str) else word
    return ((F.length(c(x)) - F.length(F.replace(c(x), w, F.lit("")))) / F.greatest(F.length(w), F.lit(1))).cast("int")


def has_any(x: str | Column, values: Iterable[str]) -> Column:
    """True if the lower-cased text holds one of the words."""
    return F.exists(words(v.lower() for v in values), lambda v: F.contains(F.lower(F.coalesce(c(x), F.lit(""))), v))


def has_negation(x: str | Column, values: Iterable[str] | None = None, word_boundary: bool = False) -> Column:
    """True if the text holds a word of negation: anywhere, or (word_boundary) Latin ones as whole words only."""
    from .constants import NEGATION_WORDS

    values = tuple(values or NEGATION_WORDS)
    if not word_boundary:
        return has_any(x, values)
    latin = [v for v in values if v.isascii()]
    rest = [v for v in values if not v.isascii()]
    whole = F.lower(F.coalesce(c(x), F.lit(""))).rlike(r"\b(" + "|".join(latin) + r")\b") if latin else F.lit(False)
    return whole | (has_any(x, rest) if rest else F.lit(False))


def sentences(x: str | Column) -> Column:
    """Sentences of a text: cut after full stops and at line ends."""
    return F.filter(F.transform(F.split(F.coalesce(c(x), F.lit("")), r"(?<=[。！？.!?])\s*|[\n\r]+"), lambda s: strip(squeeze(s))), lambda s: s != "")


def snippet(x: str | Column, word: Column) -> Column:
    """The first sentence that holds a word, in any case; null if none does."""
    return F.get(F.filter(sentences(x), lambda s: F.contains(F.lower(s), F.lower(word))), F.lit(0))


def chunks(x: str | Column, size: int = 1600, most: int = 12_000, count: int = 8) -> Column:
    """Pieces of a text of `size` characters, from its first `most` characters, at most `count` of them."""
    text = F.substring(F.coalesce(c(x), F.lit("")), 1, most)
    n = F.least(F.ceil(F.length(text) / size).cast("int"), F.lit(count))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def slug(x: str | Column, most: int = 64) -> Column:
    """Letters, digits, hyphens and CJK; the rest as hyphens."""
    value = F.regexp_replace(F.regexp_replace(F.coalesce(c(x), F.lit("")), rf"(?U)[^\w\-{CJK}]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(value == "", F.lit("query")).otherwise(value), 1, most)


def first_number(x: str | Column) -> Column:
    """The number that a counter's text stands for: first digits, with 万, 亿 and k; null without digits."""
    text = F.lower(F.coalesce(c(x).cast("string"), F.lit("")))
    n = F.expr("cast(null as double)")
    digits = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(万|亿|k|w)?", 1)
    unit = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(万|亿|k|w)?", 2)
    scale = F.when(unit.isin("万", "w"), 10_000).when(unit == "亿", 100_000_000).when(unit == "k", 1_000).otherwise(1)
    return F.when(digits == "", n).otherwise(digits.try_cast("double") * scale).cast("long")


def clip(x: Column, low: int, high: int) -> Column:
    """An integer held between two bounds; the lower one if it is none."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(x.try_cast("int"), F.lit(low))))


def report_kind(x: str | Column, mode: str = "auto") -> Column:
    """What a research question asks for: business, decision, comparison, explainer, general; or what mode says."""
    from . import constants as k

    if mode in ("consumer", "business"):
        return F.lit(mode)
    low = F.lower(F.coalesce(c(x), F.lit("")))
    hits = lambda values: F.size(F.filter(words(values), lambda v: F.contains(low, v)))
    business, shopping = hits(k.BUSINESS_WORDS), hits(k.SHOPPING_WORDS)
    return (
        F.when((business > 0) & ((business >= shopping) | has_any(low, k.BUSINESS_MARKERS)), "business")
        .when(shopping > business, "decision")
        .when(has_any(low, k.COMPARISON_WORDS), "comparison")
        .when(has_any(low, k.DECISION_WORDS), "decision")
        .when(has_any(low, k.PRODUCT_WORDS) & (has_any(low, k.BUDGET_WORDS) | has_any(low, k.PREFERENCE_WORDS)), "decision")
        .when(has_any(low, k.TREND_WORDS), "business")
        .when(has_any(low, k.EXPLAIN_WORDS), "explainer")
        .otherwise("general")
    )
