"""Row filters. Optional arguments that are None add no predicate, so what is left reaches the scan."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates as D
from ..functions.text import alternation, col, contains_any


def equal_to(df: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def any_flag(df: DataFrame, flags: list[str], column: str = "flags") -> DataFrame:
    return df.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(f) for f in flags]))) if flags else df


def in_category(df: DataFrame, category: str, column: str = "categories") -> DataFrame:
    return df.where(F.exists(column, lambda c: F.lower(c) == category.lower()))


def with_attribute(df: DataFrame, name: str, column: str = "attrs") -> DataFrame:
    return df.where(F.coalesce(F.try_element_at(F.col(column), F.lit(name)), F.lit(False)))


def on_day(df: DataFrame, ts: str, day: dt.date) -> DataFrame:
    """A half-open range on the time column, so that it is pushed to the scan."""
    nxt = day + dt.timedelta(days=1)
    return df.where((F.col(ts) >= F.lit(dt.datetime.combine(day, dt.time())).cast("timestamp_ntz"))
                    & (F.col(ts) < F.lit(dt.datetime.combine(nxt, dt.time())).cast("timestamp_ntz")))


def between_days(df: DataFrame, ts: str, first: dt.date, last: dt.date) -> DataFrame:
    """Both days included."""
    return df.where((F.col(ts) >= F.lit(dt.datetime.combine(first, dt.time())).cast("timestamp_ntz"))
                    & (F.col(ts) < F.lit(dt.datetime.combine(last + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz")))


def city_like(df: DataFrame, city: str, column: str = "city") -> DataFrame:
    return df.where(F.col(column).ilike(f"%{city}%"))


def by_source(df: DataFrame, source: str, newest: list[Column], limit: int = 100) -> DataFrame:
    return df.where(F.col("source") == source).orderBy(*newest).limit(limit)


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == value)


def events_like(df: DataFrame, category: str | None, order: list[Column], limit: int | None = None) -> DataFrame:
    """Category named in the category or tag text, ordered by start."""
    if category:
        df = df.where(F.col("category_text").ilike(f"%{category}%") | F.col("tag_text").ilike(f"%{category}%"))
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def with_words(df: DataFrame, words: list[str], *columns: str) -> DataFrame:
    """Any keyword in any of the text columns, ignoring case."""
    test = F.lit(False)
    for c in columns:
        test = test | contains_any(F.lower(F.col(c)), [w.lower() for w in words])
    return df.where(test)


def drop_reason(start, url, first, last) -> Column:
    """Why an ingest row is dropped, first reason wins; null when it is kept."""
    day = F.to_date(col(start))
    return (F.when(col(start).isNull(), F.lit("no_start"))
            .when(~day.between(col(first), col(last)), F.lit("out_of_range"))
            .when(F.coalesce(F.trim(col(url)), F.lit("")) == "", F.lit("no_url")))


def fresh_events(df: DataFrame, day: str, as_of, days: int = 14) -> DataFrame:
    return df.where(D.within_days(day, as_of, days))


def recipe_valid(required: list[str], min_name: int = 0, max_name: int = 1000, min_description: int = 0) -> Column:
    ok = F.lit(True)
    for f in required:
        ok = ok & (F.coalesce(F.col(f), F.lit("")) != "")
    name_ok = F.col("name").isNull() | F.length("name").between(min_name, max_name)
    desc_ok = (F.coalesce(F.col("description"), F.lit("")) == "") | (F.length("description") >= min_description)
    return F.coalesce(ok & name_ok & desc_ok, F.lit(False))


def good_alt(alt, src) -> Column:
    """Image text worth keeping: longer than five letters, no deny word, absolute address."""
    return F.coalesce(~F.lower(col(alt)).rlike(alternation(rules.ALT_DENY)) & (F.length(col(alt)) > 5)
                      & col(src).startswith("http"), F.lit(False))


def good_heading(text, deny: list[str] | None = None) -> Column:
    return F.coalesce(~F.lower(col(text)).rlike(alternation(deny or rules.HEADING_DENY))
                      & (F.length(col(text)) > 5) & (F.length(col(text)) < 100), F.lit(False))


def include_exclude(df: DataFrame, column: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Keep rows that match any include pattern (all, when none is given) and no exclude pattern."""
    if include:
        df = df.where(F.col(column).rlike("|".join(f"(?:{p})" for p in include)))
    if exclude:
        df = df.where(~F.col(column).rlike("|".join(f"(?:{p})" for p in exclude)))
    return df
