"""Survivorship: one row per duplicate group, through aggregates that combine on the map side."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import normalize_text
from .skew import whole


def source_rank(source: Column | str, priority: list[str] | None = None) -> Column:
    """Position in the priority list; any other source comes one step after the list's end."""
    order = priority or rules.SOURCE_PRIORITY
    low = F.lower(F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit("")))
    chain = None
    for i, name in enumerate(order):
        chain = F.when(low == name, i) if chain is None else chain.when(low == name, i)
    return chain.otherwise(len(order) + 1)


def ordered_union(df: DataFrame, group: str, seq: str, values: str, out: str, lower: bool = True) -> DataFrame:
    """(group, out): values of all member lists, unique, in order of first appearance.

    Only distinct values travel: each is first reduced to its earliest position.
    """
    one = df.select(group, seq, F.posexplode(values).alias("_pos", "_val"))
    text = F.trim("_val")
    one = one.withColumn("_val", F.lower(text) if lower else text).where(F.coalesce(F.col("_val"), F.lit("")) != "")
    first = one.groupBy(group, "_val").agg(F.min(F.struct(seq, "_pos")).alias("_at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_val"))), lambda s: s["_val"]).alias(out))


def merge_events(df: DataFrame, group: str = "group_id", seq: str = "seq", priority: list[str] | None = None) -> DataFrame:
    """One event per group: primary by source rank then newest, longest description, first real image,
    united tags, categories and sources, newest fetch time, attributes true if true anywhere.

    The members of a group stay in the input (group, seq); they are not packed into one cell.
    Expects id, title, desc, image, url, source, fetched_at, tags, categories, attrs (map of booleans).
    """
    rank = source_rank("source", priority)
    primary = F.min_by(F.struct("id", "title", "url", "source", "start", "venue"),
                       F.struct(rank, -F.unix_micros(F.col("fetched_at").cast("timestamp")), F.col(seq)))
    text = normalize_text("desc")
    real = (F.coalesce(F.col("image"), F.lit("")) != "") & ~F.col("image").startswith(rules.PLACEHOLDER_IMAGE)
    core = df.groupBy(group).agg(
        primary.alias("p"),
        F.max_by(text, F.when(F.coalesce(F.col("desc"), F.lit("")) != "", F.struct(F.length(text), -F.col(seq)))).alias("desc"),
        F.min_by("image", F.when(real, F.struct(seq))).alias("image"),
        F.max("fetched_at").alias("fetched_at"), F.count(F.lit(1)).alias("merged_count"))
    core = core.select(group, "p.*", "desc", "image", "fetched_at", "merged_count")
    true_attrs = df.select(group, F.explode("attrs").alias("k", "v")).groupBy(group, "k").agg(F.bool_or("v").alias("v"))
    attrs = true_attrs.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    lists = [ordered_union(df, group, seq, "tags", "tags"), ordered_union(df, group, seq, "categories", "categories"),
             ordered_union(df.withColumn("_src", F.array("source")), group, seq, "_src", "sources")]
    out = core.join(whole(attrs), group, "left")
    for part in lists:
        out = out.join(whole(part), group, "left")
    return out


def merge_places(df: DataFrame, group: str = "group_id", seq: str = "seq") -> DataFrame:
    """One place per group: highest confidence wins, longest description, first image and area by confidence,
    united tags, flags and methods (sorted)."""
    best = F.struct(-F.col("confidence"), F.col(seq))

    def first_of(name: str) -> Column:
        return F.min_by(name, F.when(F.coalesce(F.col(name), F.lit("")) != "", best)).alias(name)
    core = df.groupBy(group).agg(
        F.min_by("name", best).alias("name"), F.min_by("url", best).alias("url"),
        F.max_by("description", F.when(F.coalesce(F.col("description"), F.lit("")) != "",
                                       F.struct(F.length("description"), F.col("confidence"), -F.col(seq)))).alias("description"),
        first_of("image_url"), first_of("area"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("merged_from"),
        F.array_sort(F.collect_set("method")).alias("methods"))
    out = core
    for name in ("tags", "flags"):
        united = df.select(group, F.explode(name).alias("_v")).distinct().groupBy(group).agg(F.array_sort(F.collect_list("_v")).alias(name))
        out = out.join(whole(united), group, "left")
    return out
