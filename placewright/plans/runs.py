"""Pipelines to their last step: base table, search index, facets, report and log of a run change together, or not at all."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import facets, reports, search_index, tables
from ..session import cut_lineage
from ..sources.store import Store, current, latest
from . import curation, ingest

PLACE_TEXT = (["name", "description", "area"], ["tags", "flags"])


def curation_run(store: Store, run: int, places: DataFrame, day: dt.date, seq: str = "seq", **matching) -> DataFrame | None:
    """Duplicates, quality, search index and facets of new places. (status, n) of the run; None where it was applied before.

    Tables: ``status`` (seq, status, strategy, root of each row), ``places`` (the new ones), the index tables, ``facets`` (city, day, kind, key, id).
    """
    change = store.change(run)
    if change is None:
        return None
    rows = cut_lineage(curation.curate(places, seq, **matching))
    new = rows.where("status = 'new'").select(*places.columns)
    change.put("status", rows.select(seq, "status", "strategy", "root"), [seq])
    change.put("places", new, [seq])
    search_index.index_rows(change, new, seq, *PLACE_TEXT)
    change.put("facets", facets.facet_rows(new.withColumn("day", F.lit(day)), "city", "day", seq, None, "flags"), ["city", "key"])
    change.commit()
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def event_run(store: Store, run: int, batch: DataFrame, stamp: Column) -> bool:
    """Events merged, reported on and put into the stored table. False where the run was applied before.

    Tables: ``events`` (a row per merged event, the newest run's row of an id), ``members`` (group, id), ``report`` (per source, ``*`` for
    all), ``log``.
    """
    change = store.change(run)
    if change is None:
        return False
    merged, members = ingest.merge_run(batch)
    merged = cut_lineage(merged.withColumn("end", F.lit(None).cast("timestamp")))
    change.put("events", merged, ["id"])
    change.put("members", members.withColumn("run", F.lit(run)))
    change.replace("report", ingest.event_report(merged))
    change.put("log", tables.ingest_log(batch, "source", stamp))
    change.compact("events", latest(["id"], "fetched_at"))
    change.commit()
    return True


def ingest_run(store: Store, run: int, batch: DataFrame, as_of: dt.date, days_ahead: int = 2, percent: float = 0.2, stamp: Column | None = None) -> bool:
    """Window, top share, upsert, facets and log of one batch. False where the run was applied before.

    Tables: ``events`` keyed by id (the batch wins, ``fetched_at`` never goes back), ``facets`` keyed by posting, ``log``, ``dropped``.
    """
    change = store.change(run)
    if change is None:
        return False
    made = ingest.ingest_run(batch, None, as_of, days_ahead, percent, stamp)
    change.put("events", made["events"], ["id"])
    change.put("facets", made["facets"], ["city", "day", "kind", "key", "id"])
    change.put("log", made["log"])
    change.put("dropped", made["dropped"].withColumn("run", F.lit(run)))
    change.compact("events", latest(["id"], "fetched_at"))
    change.compact("facets", latest(["city", "day", "kind", "key", "id"]))
    change.commit()
    return True


def stored_events(store: Store) -> DataFrame:
    return current(store, "events", ["id"], "fetched_at")


def stored_facets(store: Store) -> DataFrame:
    return store.read("facets").drop("_run").distinct()


def index_size(store: Store) -> DataFrame:
    """(docs, terms) of the stored search index."""
    return store.spark.createDataFrame([tuple(store.state()["values"]["size"])], "docs long, terms long")


def report_of(store: Store) -> DataFrame:
    return store.read("report").drop("_run")


def status_rates(store: Store) -> DataFrame:
    """Counts and rates over all runs."""
    return reports.status_statistics(store.read("status"))
