"""Times as text, seconds and milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c


def from_epoch(x: str | Column) -> Column:
    """Timestamp of seconds or milliseconds since 1970; null if it is no number."""
    n = c(x).try_cast("double")
    return F.timestamp_seconds(F.when(n > 1e12, n / 1000).otherwise(n))


def to_epoch(x: str | Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1970 of a text; 0 if it can't be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(c(x), F.lit(pattern))), F.lit(0)).cast("long")


def from_rfc2822(x: str | Column) -> Column:
    """Timestamp of a text such as 'Sat Dec 23 17:12:54 +0800 2023'; null if it can't be read."""
    return F.try_to_timestamp(F.substring(c(x), 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))


def published(x: str | Column) -> Column:
    """Timestamp of an ISO date or time, without its zone, or of a bare year; null for other text."""
    text = F.trim(F.coalesce(c(x), F.lit("")))
    bare = F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "")
    year = F.regexp_extract(text, r"^(20\d\d)$", 1)
    return F.when(year != "", F.try_to_timestamp(F.concat(year, F.lit("-01-01")))).when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(bare))


def clock_to_ms(x: str | Column) -> Column:
    """Milliseconds of mm:ss or h:mm:ss; null if it is neither or a part is out of range."""
    p = F.split(c(x), ":")
    at = lambda i: F.get(p, F.lit(i)).try_cast("long")
    three = F.size(p) == 3
    hours = F.when(three, at(0)).otherwise(F.lit(0))
    minutes, seconds = F.when(three, at(1)).otherwise(at(0)), F.when(three, at(2)).otherwise(at(1))
    good = (F.size(p).isin(2, 3)) & (seconds < 60) & ((hours == 0) | (minutes < 60))
    return F.when(good, ((hours * 60 + minutes) * 60 + seconds) * 1000)


def ms_to_clock(x: str | Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.floor(c(x) / 1000).cast("int")
    h = F.floor(s / 3600).cast("int")
    rest = F.format_string("%02d:%02d", F.floor((s % 3600) / 60).cast("int"), s % 60)
    return F.when(h > 0, F.concat(F.format_string("%02d:", h), rest)).otherwise(rest)


def in_days(x: str | Column, start: str, end: str) -> Column:
    """True from the start day to the end of the end day."""
    return c(x).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day - interval 1 second"))


def recent(x: str | Column, latest: Column, days: int) -> Column:
    """True within so many days of the latest time."""
    return c(x) >= latest - F.expr(f"interval {days} days")
