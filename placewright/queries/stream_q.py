"""Structured Streaming jobs run to completion over the given files, then read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import work_dir
from ..sources.readers import table
from ..streaming import jobs, matching
from .inputs import places
from .registry import ORACLE, query


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return jobs.file_stream(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark) -> str:
    return f"{work_dir(spark)}/run-{uuid.uuid4().hex}"


@query("stream_ingest", "ST1 ST5 S12 S17", "SELECT user_id, arg_max(event_id, event_id) AS event_id, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY 1")
def _(spark, sf):
    root = _folder(spark)
    sink = jobs.keyed_upsert(f"{root}/t", "user_id", "ts", "event_id", "event_type")
    jobs.run_batches(_events(spark, sf), sink, f"{root}/c").awaitTermination()
    return jobs.upserted(spark, f"{root}/t", "user_id", "ts").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("last_day"))


@query("stream_exact_dedup", "ST2", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    root = _folder(spark)
    df = jobs.drop_exact_copies(_events(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    jobs.append_parquet(df, f"{root}/t", f"{root}/c").awaitTermination()
    return spark.read.parquet(f"{root}/t").select("user_id", "event_type")


@query("stream_matched_dedup", "ST2 J14", """WITH e AS (SELECT vec_id, round(embedding[1]::double, 3) AS x FROM embeddings) SELECT min(vec_id) AS seq FROM e GROUP BY x""")
def _(spark, sf):
    root = _folder(spark)
    schema = table(spark, sf, "embeddings").schema
    stream = jobs.file_stream(spark, f"{sf}/embeddings.parquet", schema).select(F.col("vec_id").alias("seq"), F.round(F.col("embedding")[0].cast("double"), 3).cast("string").alias("key"))
    plain = stream.select("seq", F.col("key").alias("name"), *[F.lit(None).cast(t).alias(c) for c, t in {"city": "string", "domain": "string", "address": "string",
                                                                                                        "geo_lat": "double", "geo_lng": "double"}.items()])
    jobs.run_batches(plain, matching.against_stored(f"{root}/t", block=[]), f"{root}/c").awaitTermination()
    return matching.kept_rows(spark, f"{root}/t").select("seq")


@query("stream_place_matches", "ST2 J10 J12 J13 J14", ORACLE["matched_rows"])
def _(spark, sf):
    """Places arrive in two runs in their order; each is matched against the stored index of those before."""
    root = _folder(spark)
    rows = places(spark, sf).select("seq", "name", "city", "domain", "address", "geo_lat", "geo_lng")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    for i in range(2):
        bounds = [low + (high + 1 - low) * k // 2 for k in (i, i + 1)]
        rows.where((F.col("seq") >= bounds[0]) & (F.col("seq") < bounds[1])).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = jobs.file_stream(spark, f"{root}/in", rows.schema)
        jobs.run_batches(stream, matching.against_stored(f"{root}/t"), f"{root}/c").awaitTermination()
    return matching.matched(spark, f"{root}/t")


@query("stream_rolling", "ST3 W8", ORACLE["rolling_metrics"])
def _(spark, sf):
    root = _folder(spark)
    states = jobs.rolling_metrics(_events(spark, sf), ["event_type"], "ts", "value")
    jobs.run_batches(states, jobs.keyed_states(f"{root}/t", ["event_type", "window_start"]), f"{root}/c", mode="update").awaitTermination()
    return jobs.last_states(spark, f"{root}/t", ["event_type", "window_start"]).select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query("stream_expiry", "ST6 C1", """SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR - INTERVAL 1 MINUTE""")
def _(spark, sf):
    """Users of whom nothing has come for twelve hours leave the state."""
    root = _folder(spark)
    gone = jobs.expired_keys(_events(spark, sf), "user_id", "ts", 12 * 3600, "1 minute")
    jobs.append_parquet(gone, f"{root}/t", f"{root}/c").awaitTermination()
    return spark.read.parquet(f"{root}/t").select("user_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("live_index_rows", "ST6 C1", """SELECT user_id, CASE WHEN age <= 43200 THEN 'fresh' ELSE 'stale' END AS state FROM (SELECT user_id, epoch((SELECT max(ts) FROM events))::bigint - epoch(max(ts))::bigint AS age FROM events GROUP BY 1) WHERE age <= 86400""")
def _(spark, sf):
    """What a read at the time of the last event still takes: fresh for twelve hours, stale for twelve more. Times count by the nearest second."""
    micros = F.unix_micros(F.max("ts").cast("timestamp"))
    built = table(spark, sf, "events").groupBy("user_id").agg(F.timestamp_seconds(F.rint(micros / 1e6).cast("long")).alias("built_at"))
    now = built.agg(F.max("built_at")).first()[0]
    return jobs.live_rows(built, F.lit(now), 43200, 43200).select("user_id", "state")
