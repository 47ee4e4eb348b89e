"""Pipelines to their last step, read back from the tables they keep."""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import tagging as TG
from ..plans import runs
from ..session import work_dir
from ..sources.store import Store
from . import sqltext as S
from .inputs import curation_places, shows, with_places
from .registry import ORACLE, query
from .resolve_q import _GROUP, _MATCH, _RANK, _show_rec, merge_input
from .score_q import QUALITY_SQL
from .search_q import _TERMS


def _store(spark) -> Store:
    return Store(spark, f"{work_dir(spark)}/run-{uuid.uuid4().hex}")


_NEW = with_places(f", {QUALITY_SQL}, {_MATCH}, fresh AS (SELECT rated.* FROM rated LEFT JOIN best b USING (seq) WHERE b.seq IS NULL AND accepted)")


@query("curation_run", "PL1 A10 T1 A20", _NEW + f""", w AS (SELECT {_TERMS.format(e="concat_ws(' ', name, coalesce(description, ''), area, array_to_string(tags, ' '), array_to_string(flags, ' '))")} AS t FROM fresh)
 SELECT 'facet' AS part, city || '|' || flag AS key, count(*) AS n FROM (SELECT DISTINCT city, seq, lower(unnest(flags)) AS flag FROM fresh) GROUP BY 2
 UNION ALL SELECT 'index', 'rows', count(*) FROM w UNION ALL SELECT 'index', 'terms', sum(len(t))::bigint FROM w UNION ALL SELECT 'places', 'new', count(*) FROM fresh""")
def _(spark, sf):
    store = _store(spark)
    runs.curation_run(store, 0, curation_places(spark, sf), dt.date(2024, 1, 1))
    facet = runs.stored_facets(store).groupBy(F.concat_ws("|", "city", "key").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("facet").alias("part"), "key", "n")
    size = runs.index_size(store).select(F.explode(F.array(F.struct(F.lit("rows").alias("key"), F.col("docs").alias("n")), F.struct(F.lit("terms").alias("key"), F.col("terms").alias("n")))).alias("x"))
    kept = store.read("places").agg(F.count(F.lit(1)).alias("n")).select(F.lit("places").alias("part"), F.lit("new").alias("key"), "n")
    return facet.unionByName(size.select(F.lit("index").alias("part"), "x.key", "x.n")).unionByName(kept)


@query("event_run", "PL2 A5 S12 S17", _show_rec(f""", {_GROUP}, m AS (SELECT arg_min(id, {_RANK} * 1e16 - epoch_us(fetched_at)) AS id, arg_min(source, {_RANK} * 1e16 - epoch_us(fetched_at)) AS source, max(length({S.norm('description')})) AS l,
  arg_min(image, seq) FILTER (coalesce(image, '') <> '' AND NOT starts_with(image, 'data:image/svg+xml')) AS image, count(*) AS c FROM g GROUP BY group_id)
 SELECT source, count(*) AS total, round(100.0 * count(image) / count(*), 2) AS image_pct, coalesce(round(avg(l), 2), 0.0) AS avg_desc_len, sum(c)::bigint AS members FROM m GROUP BY source
 UNION ALL SELECT '*', count(*), round(100.0 * count(image) / count(*), 2), coalesce(round(avg(l), 2), 0.0), sum(c)::bigint FROM m"""))
def _(spark, sf):
    store = _store(spark)
    runs.event_run(store, 0, merge_input(spark, sf), F.lit(dt.datetime(2024, 1, 1)))
    stored = runs.stored_events(store)
    members = stored.groupBy("source").agg(F.sum("merged_count").alias("members"))
    members = members.unionByName(stored.agg(F.lit("*").alias("source"), F.sum("merged_count").alias("members")))
    return runs.report_of(store).join(members, "source").select("source", "total", "image_pct", "avg_desc_len", "members")


@query("ingest_run_stored", "PL3 P13 W5 S12 S17 A20", ORACLE["ingest_run"])
def _(spark, sf):
    """A first run stores the even rows, a second one all: its rows win, and a third that repeats the second changes nothing."""
    store = _store(spark)
    batch = shows(spark, sf).withColumn("score", F.col("value")).withColumn("attrs", TG.text_attributes("title", "description"))
    for run, rows in enumerate((batch.where("seq % 2 = 0"), batch)):
        runs.ingest_run(store, run, rows, dt.date(2024, 1, 5), 4, 0.2)
    runs.ingest_run(store, 1, batch.where("seq < 0"), dt.date(2024, 1, 5), 4, 0.2)
    return runs.stored_events(store).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("raw_html_ref").alias("n_top"))


@query("ingest_facets_stored", "PL3 A20", ORACLE["ingest_facets"])
def _(spark, sf):
    store = _store(spark)
    batch = shows(spark, sf).withColumn("score", F.col("value")).withColumn("attrs", TG.text_attributes("title", "description"))
    for run, rows in enumerate((batch.where("seq % 2 = 0"), batch)):
        runs.ingest_run(store, run, rows, dt.date(2024, 1, 5), 4, 0.2)
    counts = runs.stored_facets(store).groupBy("city", "day", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("day", F.col("day").cast("string"))
