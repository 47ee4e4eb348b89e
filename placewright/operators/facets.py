"""Per-day facet index: rows (city, day, kind, key, id), bounded id chunks, counts, freshness, gaps."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .ranking import top_n

CHUNK_ROWS = 10_000


def event_days(df: DataFrame, start: str, end: str, first: dt.date | None = None, last: dt.date | None = None, out: str = "day") -> DataFrame:
    """One row per day the event runs; the calendar window is applied before days are listed."""
    s, e = F.to_date(start), F.coalesce(F.to_date(end), F.to_date(start))
    if first is not None:
        df = df.where((e >= F.lit(first)) & (s <= F.lit(last)))
        s, e = F.greatest(s, F.lit(first)), F.least(e, F.lit(last))
    return df.where(s <= e).withColumn(out, F.explode(F.sequence(s, e)))


def calendar(spark, first: dt.date, days: int) -> DataFrame:
    """(day, weekday) for each day of the window."""
    return (spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
            .withColumn("weekday", F.date_format("day", "EEEE")))


def facet_rows(df: DataFrame, city: str, day: str, ident: str, categories: str | None, flags: str | None) -> DataFrame:
    """(city, day, kind, key, id), one row per posting. A long list is many rows, not one cell."""
    lists = []
    if categories:
        lists.append(F.transform(categories, lambda c: F.struct(F.lit("category").alias("kind"), F.lower(c).alias("key"))))
    if flags:
        lists.append(F.transform(flags, lambda c: F.struct(F.lit("flag").alias("kind"), F.lower(c).alias("key"))))
    both = lists[0] if len(lists) == 1 else F.concat(*lists)
    return (df.select(col(city).alias("city"), col(day).alias("day"), F.explode(F.array_distinct(both)).alias("f"), col(ident).alias("id"))
            .select("city", "day", "f.kind", "f.key", "id").distinct())


def facet_chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(city, day, kind, key, chunk, ids, n): id lists in chunks near ``chunk_rows``.

    The number of chunks of a key comes from its counted size; an id picks its chunk by hash.
    """
    keys = ["city", "day", "kind", "key"]
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows) \
        .select(*keys, F.ceil(F.col("_n") / chunk_rows).cast("int").alias("_chunks"))
    cut = rows.join(large, keys, "left")
    chunk = F.pmod(F.xxhash64("id"), F.coalesce("_chunks", F.lit(1))).cast("int")
    return (cut.withColumn("chunk", chunk).groupBy(*keys, "chunk")
            .agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("n")))


def facet_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("city", "day", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


def day_index(rows: DataFrame) -> DataFrame:
    """(city, day, flags): map of counts per flag."""
    n = rows.where(F.col("kind") == "flag").groupBy("city", "day", "key").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("city", "day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("flags"))


def complete_days(counts: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Every day for every key, zero where nothing was found.

    Each key row lists the days itself, so no product of two tables is formed.
    """
    first, n = days.agg(F.min("day"), F.count(F.lit(1))).first()
    span = F.sequence(F.lit(first), F.date_add(F.lit(first), n - 1))
    grid = counts.select(*keys).distinct().withColumn("day", F.explode(span))
    return grid.join(counts, [*keys, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def missing_in_index(base: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups the base table has rows for and the index lacks, with their row counts."""
    found = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("db_rows"))
    return found.join(index.select(*keys).distinct(), keys, "left_anti")


def freshness_state(built_at, as_of, ttl: int = 1200, margin: int = 300) -> Column:
    """fresh, stale or miss by whole seconds of age; an unreadable time is a miss."""
    age = F.unix_seconds(col(as_of).cast("timestamp")) - F.unix_seconds(col(built_at).cast("timestamp"))
    return F.when(age.isNull(), "miss").when(age <= ttl, "fresh").when(age <= ttl + margin, "stale").otherwise("miss")


def lookup_with_fallback(wanted: DataFrame, hot: DataFrame, stale: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value from the hot index, else the stale one, else the base table, with the status of what answered."""
    out = wanted
    for name, table in (("hot", hot), ("stale", stale), ("base", base)):
        out = out.join(table.select(*keys, F.col(value).alias(f"_{name}")), keys, "left")
    status = F.when(F.col("_hot").isNotNull(), "hit").when(F.col("_stale").isNotNull(), "stale").when(F.col("_base").isNotNull(), "refresh").otherwise("empty")
    return out.withColumn(value, F.coalesce("_hot", "_stale", "_base")).withColumn("status", status).drop("_hot", "_stale", "_base")


def invalidate(index: DataFrame, city: str, keys: list[str] | None = None) -> DataFrame:
    """The index without one city, or without some keys of it."""
    gone = F.col("city") == city
    return index.where(~(gone & F.col("key").isin(keys))) if keys is not None else index.where(~gone)


def rebuild(df: DataFrame, city: str, start: str, end: str, ident: str, flags: str, wanted: list[str], first: dt.date, days: int) -> DataFrame:
    """(city, day, key, n) for every day of the window and every wanted flag, zero included."""
    last = first + dt.timedelta(days=days - 1)
    running = event_days(df, start, end, first, last)
    rows = facet_rows(running, city, "day", ident, None, flags).where(F.col("key").isin([f.lower() for f in wanted]))
    counts = rows.groupBy("city", "day", "key").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = (df.select(col(city).alias("city")).distinct()
            .withColumn("day", F.explode(F.sequence(F.lit(first), F.lit(last))))
            .withColumn("key", F.explode(F.array(*[F.lit(f.lower()) for f in wanted]))))
    return grid.join(counts, ["city", "day", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def capped_by_flag(df: DataFrame, flags: str, order: list[Column], ident: str, cap: int = 100) -> DataFrame:
    """At most ``cap`` rows per flag (the index feature), as (flag, rank, row)."""
    return top_n(df.withColumn("flag", F.explode(flags)), ["flag"], order, cap)


def warmed(df: DataFrame, flags: str, order: list[Column], ident: str, cap: int = 100) -> DataFrame:
    return capped_by_flag(df, flags, order, ident, cap).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def set_fingerprint(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Order-independent, mergeable tag of an unbounded id set: count and two 64-bit folds of distinct ids."""
    one = df.select(*keys, F.col(ident).cast("string").alias("_id")).distinct()
    part = F.conv(F.substring(F.md5("_id"), 1, 15), 16, 10).cast("long")
    return one.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(part).alias("fold_xor"),
                                  F.sum(F.pmod(part, F.lit(1_000_000_007))).alias("fold_sum"))
