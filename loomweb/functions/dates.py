"""Dates as they are written in pages, URLs and payloads; a value that is no date gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d)?$"
_SLASHED = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
_ISO = (
    r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?)?$"
)
# Dates in paths, in file names and in running text.
URL_DATE = r"/(\d{4})[-/](\d{1,2})(?:[-/](\d{1,2}))?[/.]"
URL_FILE_DATE = r"(?:[^0-9]|^)(\d{4})(\d{2})(\d{2})(?:\d{2,})?(?:\D|$)"
BODY_DATES = (
    r"(?:发布|发表|上传|更新|录入)时间[：:]\s*(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    r"(?:发布|发表|上传|更新|录入)时间[：:]\s*(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})",
    r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日",
    r"(?:[^\d]|^)(\d{4})-(\d{1,2})-(\d{1,2})(?:[^\d]|$)",
)


def made(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd, or null for a day that doesn't exist."""
    date = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.date_format(F.when(year != "0000", date), "yyyy-MM-dd")


def _by(text: Column, pattern: str) -> Column:
    return made(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))


def date_value(value: Column) -> Column:
    """The day of a date or timestamp."""
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    head = F.substr(text, F.lit(1), F.lit(19))
    return F.coalesce(
        F.when(F.rlike(head, F.lit(_PLAIN)), _by(head, _PLAIN)),
        F.when(F.rlike(head, F.lit(_SLASHED)), _by(head, _SLASHED)),
        F.when(F.rlike(text, F.lit(_ISO)), _by(text, _ISO)),
    )


def url_date(url: Column) -> Column:
    """The day in a path (the first where none is given), else one in a name; the first pattern that
    is there decides, even if it is no date."""
    day = F.regexp_extract(url, URL_DATE, 3)
    first = made(F.regexp_extract(url, URL_DATE, 1), F.regexp_extract(url, URL_DATE, 2), F.when(day == "", "1").otherwise(day))
    return F.when(F.rlike(url, F.lit(URL_DATE)), first).when(F.rlike(url, F.lit(URL_FILE_DATE)), _by(url, URL_FILE_DATE))


def body_date(text: Column) -> Column:
    """The first of the patterns that is there decides."""
    out = F.lit(None).cast("string")
    for pattern in reversed(BODY_DATES):
        out = F.when(F.rlike(text, F.lit("(?U)" + pattern)), _by(text, "(?U)" + pattern)).otherwise(out)
    return out


def published_date(meta: Column, times: Column, url: Column, marked: Column, body: Column) -> Column:
    """A page's day: from meta values, time elements, its URL, marked elements, then its text."""
    first = lambda values, parse: F.get(F.filter(F.transform(values, parse), lambda d: d.isNotNull()), 0)
    return F.coalesce(first(meta, date_value), first(times, date_value), url_date(url), first(marked, body_date), body_date(body))


def moment(value: Column) -> Column:
    """A published value as a timestamp, midnight where only a day is given."""
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    clock = F.regexp_extract(text, r"[T ](\d{2}:\d{2}(?::\d{2})?)", 1)
    at = F.concat(date_value(text), F.lit(" "), F.when(clock == "", "00:00:00").when(F.char_length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock))
    return F.try_to_timestamp(at, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def ordinal(value: Column) -> Column:
    """Days since 0001-01-01, counted from 1."""
    day = F.substr(value, F.lit(1), F.lit(10))
    date = F.when(F.rlike(day, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(day, "yyyy-MM-dd"))
    return F.datediff(date, F.lit("0001-01-01").cast("date")) + 1
