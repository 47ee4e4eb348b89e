"""Top-N, keep-first, global rank, paging and week planning.

``row_number() <= n`` lets Spark prune each partition to n rows per group before the shuffle, so a hot group
never moves whole.
"""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col
from ..session import cut_lineage

PAGE_IN_HEAP = 10_000
ID_CELLS = 256


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; ``order`` must end in a unique column."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in arrival order."""
    return top_n(df, keys, order, 1, "_first").drop("_first")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows of the whole table: a bounded heap per partition, merged once."""
    return df.orderBy(*order).limit(n)


def capped_union(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Unique by key in arrival order, then at most n rows in all."""
    return first_rows(keep_first(df, keys, order), order, n)


def _as_number(df: DataFrame, ident: str) -> Column:
    """A number that never falls where the id rises: the id itself, or the first six bytes of a text."""
    if not isinstance(df.schema[ident].dataType, T.StringType):
        return F.col(ident).cast("double")
    return F.conv(F.rpad(F.substring(F.hex(F.col(ident)), 1, 12), 12, "0"), 16, 10).cast("double")


def global_rank(df: DataFrame, score: str, ident: str, rank: str = "rank", descending: bool = True) -> DataFrame:
    """Zero-based rank over the whole table (score, then ``ident`` ascending), without one task sorting all rows.

    Cut points come from an approximate sketch and only decide the cells; the rank itself is exact. A score equal
    to a cut point has its own cell, split again by ranges of ``ident`` (a number, or a text read by its first bytes),
    so heavy ties spread out. Null scores come last.
    """
    sign = -1.0 if descending else 1.0
    key = F.coalesce(F.col(score).cast("double") * sign, F.lit(float("inf")))
    base = df.withColumn("_key", key)
    steps = [i / 1000 for i in range(1, 1000)]
    # infinite scores, like nulls, are cells of their own and no cut points
    finite = F.when((F.col("_key") > float("-inf")) & (F.col("_key") < float("inf")), F.col("_key"))
    base = base.withColumn("_num", _as_number(df, ident))
    cuts, lo, hi = base.agg(F.percentile_approx(finite, steps, 10000), F.min("_num"), F.max("_num")).first()
    splits = [float("-inf"), *sorted(set(cuts or [0.0])), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_key", outputCol="_b", handleInvalid="keep").transform(base)
    lower = F.element_at(F.lit(splits), F.col("_b").cast("int") + 1)
    missing, last = F.col(score).isNull(), F.col("_key") == float("inf")
    exact = (F.col("_key") == lower) | missing | last
    span = float((hi or 0) - (lo or 0) + 1)
    part = F.floor((F.col("_num") - F.lit(float(lo or 0))) / F.lit(span) * ID_CELLS)
    cell = F.when(missing, 2 * len(splits) + 1).when(last, 2 * len(splits)).otherwise(F.col("_b") * 2 + F.when(exact, 0).otherwise(1))
    placed = (placed.withColumn("_cell", cell.cast("int"))
              .withColumn("_part", F.when(exact, F.least(part, F.lit(ID_CELLS - 1))).otherwise(F.lit(0)).cast("int")))
    sizes = placed.groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2 * 1000 * ID_CELLS rows, whatever the table holds
    order = Window.orderBy("_cell", "_part")
    starts = sizes.select("_cell", "_part", (F.sum("_n").over(order) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy(F.col("_key"), F.col(ident)))
    return (placed.join(F.broadcast(starts), ["_cell", "_part"])
            .withColumn(rank, F.col("_start") + inside - 1)
            .drop("_cell", "_part", "_b", "_key", "_num", "_start"))


def top_percent(df: DataFrame, score: str, ident: str, percent: float) -> DataFrame:
    """Rows whose rank lies in the top share: rank < max(1, ceil(n * percent))."""
    total = df.count()
    limit = max(1, math.ceil(total * percent)) if total > 0 and percent > 0 else 0
    ranked = global_rank(df, score, ident)
    return ranked.where(F.col("rank") < limit)


def mark_top_percent(df: DataFrame, score: str, ident: str, percent: float, flag: str = "in_top") -> DataFrame:
    total = df.count()
    limit = max(1, math.ceil(total * percent)) if total > 0 and percent > 0 else 0
    return global_rank(df, score, ident).withColumn(flag, F.col("rank") < limit)


SORTS = {"quality": "quality_score", "popularity": "popularity", "name": "name", "updated_at": "updated_at",
         "relevance": "relevance"}


def sort_order(mode: str, ident: str, descending: bool = True) -> list[Column]:
    c = F.col(SORTS[mode])
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(ident).asc()]


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page with total, page number and neighbour marks on every row."""
    total = df.count()
    start = (page - 1) * size
    rows = df.orderBy(*order).offset(start).limit(size) if start + size <= PAGE_IN_HEAP else \
        _deep_page(df, order, start, size)
    return (rows.withColumn("total", F.lit(total)).withColumn("page", F.lit(page))
            .withColumn("has_next", F.lit(start + size < total)).withColumn("has_prev", F.lit(page > 1)))


def _deep_page(df: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """Deep pages: rows are range-partitioned and sorted, and only whole-partition counts reach the driver."""
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = sorted(ranged.groupBy("_pid").count().collect())
    pieces, seen = [], 0
    for pid, n in sizes:
        a, b = max(start - seen, 0), min(start + size - seen, n)
        if a < b:
            pieces.append((pid, a, b))
        seen += n
    if not pieces:
        return df.limit(0)
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    wanted = F.lit(False)
    for pid, a, b in pieces:
        wanted = wanted | ((F.col("_pid") == pid) & (F.col("_pos") > a) & (F.col("_pos") <= b))
    return (ranged.where(F.col("_pid").isin([p for p, _, _ in pieces])).withColumn("_pos", inside)
            .where(wanted).drop("_pid", "_pos").orderBy(*order))


def rank_by(df: DataFrame, mode: str, ident: str, limit: int, descending: bool = True) -> DataFrame:
    return first_rows(df, sort_order(mode, ident, descending), limit)


def filled_count(names: list[str]) -> Column:
    """How many of the text columns are filled."""
    total = F.lit(0)
    for n in names:
        total = total + F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) != "", 1).otherwise(0)
    return total


def best_filled(df: DataFrame, keys: list[str], names: list[str], order: Column) -> DataFrame:
    """Per key the record with most filled fields, earliest first on ties."""
    return keep_first(df.withColumn("_filled", filled_count(names)), keys, [F.desc("_filled"), order]).drop("_filled")


WEEK = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def plan_week(df: DataFrame, order: list[Column], title: str, source: str, tags: str) -> DataFrame:
    """The i-th of the first seven rows goes to the i-th weekday."""
    seven = first_rows(df, order, len(WEEK))
    slot = F.row_number().over(Window.orderBy(*order))
    days = F.array(*[F.lit(d) for d in WEEK])
    return seven.withColumn("slot", slot).select(
        "slot", F.element_at(days, F.col("slot")).alias("day"), F.lit("evening").alias("time"),
        col(title).alias("name"), col(source).alias("source"), col(tags).alias("tags"))


def week_plan_text(plan: DataFrame, city: str, tags: list[str]) -> DataFrame:
    """The plan as one text; the input has at most seven rows per day slot."""
    days = plan.sparkSession.createDataFrame([(i + 1, d) for i, d in enumerate(WEEK)], "n int, day string")
    line = F.format_string("  - %s — %s [%s] (%s)", F.initcap("time"), F.col("name"),
                           F.array_join("tags", ", "), F.col("source"))
    body = (days.join(plan, "day", "left")
            .groupBy("n", "day").agg(F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", line.alias("line"))))).alias("items"))
            .select("n", F.concat(F.lit("\n"), F.col("day"), F.lit(":\n"),
                                  F.when(F.size("items") > 0, F.array_join(F.transform("items", lambda i: i["line"]), "\n"))
                                  .otherwise(F.lit("  - (free)"))).alias("block")))
    head = f"=== WEEK PLAN: {city} ===\nTags: {', '.join(tags) if tags else '(no tags)'}\n"
    ordered = F.array_sort(F.collect_list(F.struct("n", "block")))
    return body.agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda b: b["block"]), "\n")).alias("text"))


def day_cards(df: DataFrame, day: str, order: list[Column], per_day: int = 6) -> DataFrame:
    """At most ``per_day`` rows for each day; no order of days is implied."""
    return top_n(df, [day], order, per_day, "position")


def mark_top(df: DataFrame, order: list[Column], limit: int, top: int = 3) -> DataFrame:
    """First ``limit`` rows of the table with their position and a mark on the first ``top``."""
    rows = first_rows(df, order, limit)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order))).withColumn("is_top", F.col("position") <= top)
