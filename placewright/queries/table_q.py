"""Upserts, patches, deletes, logs, nested values, set algebra."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import tables as T
from ..sources import readers, sinks
from ..sources.readers import table
from .inputs import places, shows, with_places, with_shows
from .registry import query

J = lambda c: F.concat_ws("|", c)


@query("upsert_latest", "S12 ST4", """WITH base AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS at FROM orders WHERE o_orderpriority <> '1-URGENT'),
 batch AS (SELECT o_orderkey AS id, 'X' AS status, o_totalprice + 1 AS price, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 - 2)::int AS at FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
 SELECT coalesce(b.id, a.id) AS id, coalesce(b.status, a.status) AS status, round(coalesce(b.price, a.price), 2) AS price, strftime(greatest(a.at, b.at), '%Y-%m-%d') AS at FROM base a FULL JOIN batch b ON a.id = b.id""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderpriority")
    base = o.where("o_orderpriority <> '1-URGENT'").drop("o_orderpriority")
    moved = F.expr("at + make_dt_interval(cast(id % 5 - 2 as int))")
    batch = o.where("o_orderpriority in ('1-URGENT', '2-HIGH')").select("id", F.lit("X").alias("status"), (F.col("price") + 1).alias("price"), moved.alias("at"))
    return T.upsert_events(base, batch, "id", "at").select("id", "status", F.round("price", 2).alias("price"), F.date_format("at", "yyyy-MM-dd").alias("at"))


@query("insert_or_replace", "S13", with_places("""SELECT seq FROM places p WHERE NOT EXISTS (SELECT 1 FROM places q WHERE q.seq > p.seq AND q.source = p.source AND q.source_url = p.source_url)"""))
def _(spark, sf):
    df = places(spark, sf).select("seq", "id", "source", "source_url")
    middle = df.agg(F.floor(F.max("seq") / 2)).first()[0]
    base = df.where(F.col("seq") <= middle).withColumn("ord", F.col("seq"))
    batch = df.where(F.col("seq") > middle).withColumn("ord", F.col("seq"))
    return T.insert_or_replace(base, batch, "ord").select("seq")


@query("patch_rows", "S14", """SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'NATION_3' ELSE c_mktsegment END AS segment, CASE WHEN c_nationkey IN (3, 4) AND c_acctbal < 0 THEN 0 ELSE c_acctbal END AS bal, CASE WHEN c_nationkey = 3 OR (c_nationkey = 4 AND c_acctbal < 0) THEN '2024-06-01' ELSE '2024-01-01' END AS updated_at FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"), F.lit("2024-01-01").alias("updated_at"))
    changes = c.where("c_nationkey in (3, 4)").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") == 3, F.lit("NATION_3")).alias("segment"), F.when(F.col("c_acctbal") < 0, F.lit(0.0)).alias("bal"))
    return T.patch(base, changes, "id", "updated_at", F.lit("2024-06-01"))


@query("delete_rows", "S15 S16", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return T.delete_keys(base, gone)


@query("guarded_change", "S16", "SELECT DISTINCT o_custkey * 2 AS id, o_custkey * 2 IN (SELECT c_custkey FROM customer) AS done FROM orders")
def _(spark, sf):
    return T.guarded(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id")))


@query("ingest_log", "S17", with_shows("SELECT source, count(*) AS \"count\", true AS ok, '2024-02-01' AS ts FROM shows GROUP BY 1"))
def _(spark, sf):
    log = T.ingest_log(shows(spark, sf), "source", F.lit(dt.date(2024, 2, 1)))
    return log.select("source", "count", "ok", F.col("ts").cast("string").alias("ts"))


@query("new_columns", "S18", "SELECT n_nationkey AS k, n_name AS name, NULL::varchar AS region FROM nation UNION ALL SELECT r_regionkey + 100, NULL, r_name FROM region")
def _(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return T.append_with_new_columns(a, table(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("k"), F.col("r_name").alias("region")))


@query("json_text_columns", "S6 S7", with_shows("SELECT seq, CASE WHEN seq % 10 = 0 THEN 0 ELSE len(tags) END AS n_tags, CASE WHEN seq % 10 = 0 THEN '' ELSE array_to_string(tags, ',') END AS joined, cast(json_extract(props, '$.k') AS int) AS k FROM shows"))
def _(spark, sf):
    df = shows(spark, sf).withColumn("text", F.when(F.col("seq") % 10 == 0, F.lit("[broken")).otherwise(T.encode("tags")))
    tags = T.decode_list("text")
    return df.select("seq", F.size(tags).alias("n_tags"), T.joined(tags).alias("joined"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("snapshot_paths", "S22", "SELECT event_id, strftime(ts, '%Y/%m/%d/') || event_id::varchar || '.html.gz' AS path FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", sinks.snapshot_path("event_id", "ts").alias("path"))


@query("foreign_rows", "S23", "SELECT s_suppkey::varchar AS id, s_name AS name, 'bangkok' AS city, 0.5 AS popularity, 2 AS price_level, 0 AS n_photos FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return readers.to_curation_shape(s).select("id", "name", "city", "popularity", "price_level", F.size("photos").alias("n_photos"))


@query("event_rows", "S24", with_shows("SELECT trim(title) AS title, cast(day AS varchar) AS date, nullif(trim(venue), '') AS venue, nullif(trim(description), '') AS desc_, len(tags) AS n_tags, source FROM shows"))
def _(spark, sf):
    df = shows(spark, sf).select(F.concat(F.lit(" "), "title").alias("title"), F.col("day").cast("string").alias("date"), F.col("until").alias("end"), F.col("time_str").alias("time"), F.col("category_text").alias("category_hint"), F.coalesce("venue", F.lit(" ")).alias("venue"),
                                 F.lit("").alias("address"), F.col("description").alias("desc"), "popularity", "price_min", F.lit(None).cast("double").alias("rating"), F.lit("").alias("subtitle"), "tags", "image", "source", "url")
    return readers.event_shape(df).select("title", "date", "venue", F.col("desc").alias("desc_"), F.size("tags").alias("n_tags"), "source")


@query("source_union", "U1", "SELECT name, src, pos FROM (SELECT c_name AS name, 'customers' AS src, 0 AS pos FROM customer UNION ALL SELECT s_name, 'suppliers', 1 FROM supplier UNION ALL SELECT p_name, 'parts', 2 FROM part)")
def _(spark, sf):
    parts = {"customers": table(spark, sf, "customer").select(F.col("c_name").alias("name")), "suppliers": table(spark, sf, "supplier").select(F.col("s_name").alias("name")), "parts": table(spark, sf, "part").select(F.col("p_name").alias("name"))}
    return readers.union_sources(parts).select("name", F.col("source_name").alias("src"), F.col("source_pos").alias("pos"))


@query("source_failure", "UD5", "SELECT c_custkey AS id FROM customer")
def _(spark, sf):
    good = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    bad = readers.readable(lambda: spark.read.parquet(f"{sf}/no_such_table.parquet"), good.limit(0))
    return good.unionByName(bad)


@query("set_algebra", "U2 U3 U4 U5", with_places("""SELECT seq, array_to_string(list_sort(list_distinct(list_concat(tags, flags))), '|') AS united, list_has_any(tags, ['food', 'bar']) AS overlaps, list_has_all(flags, ['rooftop', 'bars']) AS complete,
 array_to_string(list_filter(['art', 'food', 'view'], lambda x: NOT list_contains(tags, x)), '|') AS missing FROM places"""))
def _(spark, sf):
    wanted = F.array(F.lit("art"), F.lit("food"), F.lit("view"))
    both = F.array(F.lit("rooftop"), F.lit("bars"))
    return places(spark, sf).select("seq", J(F.array_sort(F.array_union("tags", "flags"))).alias("united"), F.arrays_overlap("tags", F.array(F.lit("food"), F.lit("bar"))).alias("overlaps"),
                                    (F.size(F.array_except(both, "flags")) == 0).alias("complete"), J(F.array_except(wanted, "tags")).alias("missing"))


@query("label_sets", "U5 J18", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")
