"""Date columns. Nothing reads the clock: relative forms take ``as_of``."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def local_day(ts: Column | str, zone: str = "Asia/Bangkok") -> Column:
    """Calendar day of a UTC instant in the given zone."""
    return F.to_date(F.from_utc_timestamp(col(ts).cast("timestamp"), zone))


def month_number(name: Column | str) -> Column:
    """1..12 by the first three letters, 0 when unknown."""
    return ((F.instr(F.lit("".join(MONTHS)), F.rpad(F.lower(col(name)), 3, "?")) + 2) / 3).cast("int")


def make_day(year, month, day) -> Column:
    """Null for missing parts and impossible dates."""
    return F.concat(col(year).cast("string"), F.lit("-"), col(month).cast("string"), F.lit("-"),
                    col(day).cast("string")).try_cast("date")


def _group(text: Column, pattern: str, i: int) -> Column:
    """Matched group, empty text when nothing matches."""
    return F.regexp_extract(text, "(?i)" + pattern, i)


def parse_absolute(x: Column | str, as_of: Column | str) -> Column:
    """``12 Jan 2025``, ``Jan 12, 2025``, ISO, then the two forms without a year (year of ``as_of``)."""
    text = col(x)
    dmy, mdy = rf"\b(\d{{1,2}})\s+{MONTH}\s+(\d{{4}})\b", rf"\b{MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    iso = r"\b(\d{4})-(\d{2})-(\d{2})\b"
    dm, md = rf"\b(\d{{1,2}})\s+{MONTH}\b", rf"\b{MONTH}\s+(\d{{1,2}})\b"
    year = F.year(col(as_of))
    return F.coalesce(
        make_day(_group(text, dmy, 3), month_number(_group(text, dmy, 2)), _group(text, dmy, 1)),
        make_day(_group(text, mdy, 3), month_number(_group(text, mdy, 1)), _group(text, mdy, 2)),
        _group(text, iso, 0).try_cast("date"),
        make_day(year, month_number(_group(text, dm, 2)), _group(text, dm, 1)),
        make_day(year, month_number(_group(text, md, 1)), _group(text, md, 2)))


def parse_day_range(x: Column | str, as_of: Column | str) -> Column:
    """Struct (start, end): ``4–6 Jan``, ``Jan 4–6``, end of month, every friday, else one date."""
    low, day0 = F.lower(F.trim(col(x))), col(as_of)
    a = rf"^(\d{{1,2}})\s*[–\-]\s*(\d{{1,2}})\s*{MONTH}"
    b = rf"^{MONTH}\s+(\d{{1,2}})\s*[–\-]\s*(\d{{1,2}})"
    year = F.year(day0)

    def both(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"))
    day_first = both(make_day(year, month_number(_group(low, a, 3)), _group(low, a, 1)), make_day(year, month_number(_group(low, a, 3)), _group(low, a, 2)))
    month_first = both(make_day(year, month_number(_group(low, b, 1)), _group(low, b, 2)), make_day(year, month_number(_group(low, b, 1)), _group(low, b, 3)))
    next_friday = F.next_day(F.date_sub(day0, 1), "FRI")
    return (F.when(low.rlike(a), day_first).when(low.rlike(b), month_first)
            .when(low.rlike("end of (the )?month|до конца месяца|สิ้นเดือน"), both(day0, F.last_day(day0)))
            .when(low.rlike("every friday|кажд.*пятниц|ทุกวันศุกร์"), let(next_friday, lambda d: both(d, d)))
            .otherwise(let(parse_absolute(x, as_of), lambda d: both(d, d))))


def parse_dash_range(x: Column | str, as_of: Column | str) -> Column:
    """Struct (start, end) of ``6 Sep — 7 Dec 2025``; missing month and year come from the end."""
    parts = F.split(F.regexp_replace(col(x), "[–—]", "-"), r"\s*-\s*")
    first, last = F.trim(F.element_at(parts, 1)), F.trim(F.element_at(parts, -1))

    def spread(end: Column) -> Column:
        month = F.coalesce(F.nullif(month_number(_group(first, MONTH, 1)), F.lit(0)), F.month(end))
        year = F.coalesce(_group(first, r"\b(\d{4})\b", 1).try_cast("int"), F.year(end))
        start = F.when(F.size(parts) == 1, end).otherwise(make_day(year, month, _group(first, r"^(\d{1,2})\b", 1)))
        return let(start, lambda s: F.struct(F.when(end.isNotNull(), s).alias("start"), F.when(s.isNotNull(), end).alias("end")))
    return let(parse_absolute(last, as_of), spread)


def fill_start_end(start, end, text, as_of) -> Column:
    """Missing dates from each other, or both from the text."""
    given = F.struct(col(start).alias("start"), col(end).alias("end"))
    both_missing = col(start).isNull() & col(end).isNull()
    chosen = F.when(both_missing, parse_day_range(text, as_of)).otherwise(given)
    return let(chosen, lambda r: F.struct(F.coalesce(r["start"], r["end"]).alias("start"), F.coalesce(r["end"], r["start"]).alias("end")))


def day_bounds(ts: Column | str) -> Column:
    start = F.date_trunc("day", col(ts))
    return F.struct(start.alias("start"), (start + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).alias("end"))


def plan_window(mode: str, as_of: Column | str) -> Column:
    return F.struct(col(as_of).alias("start"),
                    (F.date_add(col(as_of), 6) if mode == "week" else col(as_of)).alias("end"))


def within_days(day, as_of, days: int = 7) -> Column:
    return F.coalesce(col(day).between(col(as_of), F.date_add(col(as_of), days)), F.lit(False))


def ranges_overlap(s1, e1, s2, e2) -> Column:
    """False when any bound is missing."""
    known = col(s1).isNotNull() & col(e1).isNotNull() & col(s2).isNotNull() & col(e2).isNotNull()
    return known & (F.greatest(col(s1), col(s2)) <= F.least(col(e1), col(e2)))


def range_within_days(start, end, as_of, days: int = 7) -> Column:
    window_end = F.date_add(col(as_of), days)
    return F.when(col(end).isNull(), within_days(start, as_of, days)).otherwise(
        ranges_overlap(start, end, as_of, window_end))


def day_in_range(day, start, end) -> Column:
    return F.coalesce(col(day).between(col(start), col(end)), F.lit(False))
