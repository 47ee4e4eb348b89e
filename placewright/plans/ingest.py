"""Event runs: union, merge, report, range filter, top share mark, upsert, log, facet index."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import tagging as TG
from ..functions.text import normalize_text
from ..operators import facets, filters, graph, merge, ranking, reports, resolve, tables
from ..operators.skew import HOT_ROWS, whole
from ..session import cut_lineage


def with_event_keys(df: DataFrame) -> DataFrame:
    """Adds identity, day, norm_title and norm_venue."""
    return (df.withColumn("identity", K.event_identity("title", "start", "venue")).withColumn("day", F.to_date("start"))
            .withColumn("norm_title", F.lower(normalize_text("title"))).withColumn("norm_venue", F.lower(normalize_text("venue"))))


def group_events(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds group_id: the smallest seq of all events found to be the same."""
    keyed = with_event_keys(df)
    narrow = cut_lineage(keyed.select("seq", "identity", "day", "norm_title", "norm_venue"))
    roots = graph.components(resolve.event_links(narrow, hot_rows=hot_rows), hot_rows=hot_rows)
    return keyed.join(whole(roots.select(F.col("id").alias("seq"), "component")), "seq", "left").withColumn("group_id", F.coalesce("component", "seq")).drop("component")


def merge_run(df: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(merged events, membership rows (group_id, id))."""
    grouped = group_events(df, hot_rows)
    return merge.merge_events(grouped), grouped.select("group_id", "id")


def event_report(df: DataFrame) -> DataFrame:
    """Per source fill rates, and one row for all sources."""
    per = reports.event_quality(df, ["source"], "start", "end", "image", "desc")
    total = reports.event_quality(df, [], "start", "end", "image", "desc").withColumn("source", F.lit("*"))
    return per.unionByName(total)


def ingest_run(batch: DataFrame, stored: DataFrame, as_of: dt.date, days_ahead: int = 2, percent: float = 0.2,
               stamp: Column | None = None) -> dict[str, DataFrame]:
    """Keep the window, mark the top share, upsert, log and index. Returns the tables to write."""
    last = as_of + dt.timedelta(days=days_ahead)
    marked = batch.withColumn("reason", filters.drop_reason("start", "url", F.lit(as_of), F.lit(last)))
    kept = marked.where(F.col("reason").isNull()).drop("reason")
    top = ranking.mark_top_percent(kept, "score", "seq", percent).drop("rank")
    events = top.withColumn("raw_html_ref", F.when(F.col("in_top"), F.concat(F.date_format("start", "yyyy/MM/dd/"), "id", F.lit(".html.gz")))).drop("in_top")
    table = tables.upsert_events(stored, events, "id", "fetched_at", "seq") if stored is not None else tables.first_version(events, "id", "fetched_at", "seq")
    flags = TG.true_keys("attrs")
    rows = facets.facet_rows(events.withColumn("day", F.to_date("start")).withColumn("_flags", flags), "city", "day", "id", "categories", "_flags")
    return {"dropped": marked.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "events": table, "facets": rows,
            "log": tables.ingest_log(events, "source", stamp if stamp is not None else F.lit(dt.datetime.combine(as_of, dt.time())))}
