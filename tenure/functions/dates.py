"""Dates in career documents: parsing, open ends, ranges, month labels. ``today`` is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenure.functions.patterns import let

# Month names by their first three letters, words of an open end, range separators.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
OPEN_END = r"(?iu)\b(present|current|till\s*date|now|ongoing)\b"
SEPARATOR = r"(?iu)\s*(?:–|—|-|\bto\b)\s*"

_NAMED = r"([A-Za-z]{3,9})\.?\s*[’']?\s*(\d{4}|\d{2})\b"
_MONTH_FIRST = r"\b(\d{1,2})[/.\-](\d{4})\b"
_YEAR_FIRST = r"\b(\d{4})[/.\-](\d{1,2})\b"
_YEAR = r"\b((?:19|20)\d{2})\b"


def _number(s: Column) -> Column:
    return let(s, lambda x: F.when(x != "", x.cast("int")))


def _day(year: Column, month: Column, end: bool) -> Column:
    """First or last day of a month; null for a month that there isn't, or no year."""
    day = let(month, lambda m: F.when(m.between(1, 12), let(year, lambda y: F.when(y > 0, F.make_date(y, m, F.lit(1))))))
    return F.last_day(day) if end else day


def parse_date(text: Column, end: bool = False) -> Column:
    """Date of a text: month name and year, mm/yyyy, yyyy/mm or a bare year; the first day, or the last (``end``)."""

    def read(t: Column) -> Column:
        group = lambda pattern, k: F.regexp_extract(t, pattern, k)
        known = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(group(_NAMED, 1), 1, 3))).cast("int")
        year = let(_number(group(_NAMED, 2)), lambda y: F.when(y < 100, y + 2000).otherwise(y))
        whole = let(_number(group(_YEAR, 1)), lambda y: F.when(y.isNotNull(), F.make_date(y, F.lit(12 if end else 1), F.lit(31 if end else 1))))
        return F.coalesce(
            _day(year, known, end), _day(_number(group(_MONTH_FIRST, 2)), _number(group(_MONTH_FIRST, 1)), end),
            _day(_number(group(_YEAR_FIRST, 1)), _number(group(_YEAR_FIRST, 2)), end), whole,
        )

    return let(text, read)


def is_open_ended(text: Column) -> Column:
    return F.coalesce(text.rlike(OPEN_END), F.lit(False))


def parse_range(text: Column, today: dt.date) -> Column:
    """struct(start, end, is_current). Splits at the first separator; an open, missing or unreadable end is today."""
    now = F.lit(today).cast("date")

    def span(t: Column) -> Column:
        blank = F.coalesce(F.trim(t), F.lit("")) == ""
        parts = lambda use: let(F.split(t, SEPARATOR, 2), use)
        return parts(lambda p: let(parse_date(F.get(p, F.lit(0))), lambda start: let(F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))), lambda tail: closed(blank, start, tail))))

    def closed(blank: Column, start: Column, tail: Column) -> Column:
        def ended(end: Column) -> Column:
            current = ~blank & ((tail == "") | is_open_ended(tail) | (end.isNull() & start.isNotNull()))
            return let(current, lambda open_: let(F.when(open_, now).otherwise(end), lambda stop: whole(open_, stop)))

        def whole(open_: Column, stop: Column) -> Column:
            after = F.make_date(F.year(start), F.least(F.month(start) + 1, F.lit(12)), F.lit(28))
            stop = F.when((stop < start) & (F.year(stop) == F.year(start)), after).otherwise(stop)
            return F.struct(F.when(~blank, start).alias("start"), F.when(~blank, stop).alias("end"), open_.alias("is_current"))

        return let(parse_date(tail, end=True), ended)

    return let(text, span)


def month_label(months: Column) -> Column:
    """"2 years 1 month"; "0 months" for nothing."""
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise("")))
    years, rest = F.floor(months / 12), months % 12
    return F.when(months <= 0, "0 months").otherwise(F.concat_ws(" ", part(years, "year"), part(rest, "month")))
