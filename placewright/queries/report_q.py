"""Reports, statistics, metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import facets as FA
from ..operators import ranking as W
from ..operators import reports as R
from ..plans import ingest as PI
from ..sources.readers import table
from . import sqltext as S
from .inputs import places, shows, with_places, with_shows
from .registry import query


@query("table_statistics", "A1", with_places("""SELECT kind, key, count(*) AS n FROM (SELECT 'source' AS kind, source AS key FROM places UNION ALL SELECT 'city', city FROM places UNION ALL SELECT 'flag', unnest(flags) FROM places) GROUP BY 1, 2
 UNION ALL (SELECT 'area', area, count(*) AS n FROM places GROUP BY 2 ORDER BY n DESC, area LIMIT 10)"""))
def _(spark, sf):
    return R.table_statistics(places(spark, sf))


@query("table_totals", "A1", with_places("SELECT count(*) AS total, round(avg(quality_score) FILTER (quality_score > 0), 4) AS avg_quality, cast(min(updated_at) AS varchar) AS first_update, cast(max(updated_at) AS varchar) AS last_update FROM places"))
def _(spark, sf):
    return R.table_totals(places(spark, sf)).select("total", "avg_quality", F.col("first_update").cast("string").alias("first_update"), F.col("last_update").cast("string").alias("last_update"))


@query("city_statistics", "A2", with_places("""SELECT city, kind, key, count(*) AS n, round(avg(rating), 1) AS mean_rating FROM (SELECT city, rating, 'category' AS kind, unnest(tags) AS key FROM places UNION ALL SELECT city, rating, 'price', price_level::varchar FROM places
 UNION ALL SELECT city, rating, 'all', 'all' FROM places) GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return R.city_statistics(places(spark, sf), "tags", "price_level", "rating")


@query("source_statistics", "A3", with_places("SELECT source, flag, area, count(*) AS n FROM (SELECT source, area, unnest(flags) AS flag FROM places) GROUP BY 1, 2, 3"))
def _(spark, sf):
    return R.source_statistics(places(spark, sf), "source", "flags", "area")


@query("flag_labels", "A4", with_places("SELECT flag, array_to_string(list_transform(string_split(replace(flag, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label FROM (SELECT DISTINCT unnest(flags) AS flag FROM places)"))
def _(spark, sf):
    return R.flag_labels(places(spark, sf), "flags")


_PCT = "round(count({c}) * 100.0 / count(*), 2)"
_REPORT = f"""count(*) AS total, {_PCT.format(c='start')} AS start_pct, {_PCT.format(c='until')} AS end_pct, {_PCT.format(c='image')} AS image_pct, coalesce(round(avg(length(description)), 2), 0) AS avg_desc_len, coalesce(median(length(description)), 0) AS median_desc_len"""


@query("event_quality_report", "A5", with_shows(f"SELECT source, {_REPORT} FROM shows GROUP BY 1 UNION ALL SELECT '*', {_REPORT} FROM shows"))
def _(spark, sf):
    df = shows(spark, sf).withColumn("end", F.col("until")).withColumn("desc", F.col("description"))
    return PI.event_report(df).select("source", "total", "start_pct", "end_pct", "image_pct", "avg_desc_len", "median_desc_len")


@query("document_quality_report", "A5 A13", "SELECT source, count(*) AS total, round(avg(length(text)), 2) AS avg_len, median(length(text)) AS median_len, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def _(spark, sf):
    df = table(spark, sf, "documents").withColumn("none", F.lit(None).cast("string"))
    rep = R.event_quality(df, ["source"], "none", "none", "none", "text")
    lab = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("labelled"))
    return rep.join(lab, "source", "left").select("source", "total", F.col("avg_desc_len").alias("avg_len"), F.col("median_desc_len").alias("median_len"), F.coalesce("labelled", F.lit(0)).alias("labelled"))


_FIELDS = ["name", "address", "description", "phone", "hours", "image_url"]


@query("field_completeness", "A13 U5", with_places("SELECT city AS key, count(*) AS n, round(avg(round(" + " + ".join(f"(coalesce(trim({f}), '') <> '')::int" for f in _FIELDS) + ", 0) * 100.0 / 6), 2) AS mean_score, " + ", ".join(f"sum((coalesce(trim({f}), '') = '')::int) AS missing_{f}" for f in _FIELDS) + " FROM places GROUP BY 1"))
def _(spark, sf):
    return R.collection_report(places(spark, sf), _FIELDS, "city").withColumn("mean_score", F.round("mean_score", 2))


@query("tag_venue_distribution", "A13", with_shows("SELECT kind, key, count(*) AS n FROM (SELECT 'tag' AS kind, lower(trim(unnest(tags))) AS key FROM shows UNION ALL SELECT 'venue', venue FROM shows WHERE venue IS NOT NULL) GROUP BY 1, 2"))
def _(spark, sf):
    df = shows(spark, sf)
    tags = R.list_counts(df.select(F.transform("tags", lambda t: F.lower(F.trim(t))).alias("tags")), "tags", "tag")
    return tags.unionByName(R.list_counts(df.select(F.array_compact(F.array("venue")).alias("venue")), "venue", "venue"))


@query("day_diagnostics", "A14 J16", with_shows("""SELECT kind, key, count(*) AS n FROM (SELECT 'source' AS kind, source AS key FROM d UNION ALL SELECT 'day', cast(d AS varchar) FROM d UNION ALL SELECT 'flag', unnest(categories) FROM d WHERE venue IS NOT NULL UNION ALL SELECT 'unflagged', 'all' FROM d WHERE venue IS NULL) GROUP BY 1, 2""")
       .replace(" SELECT kind", ", d AS (SELECT *, cast(unnest(generate_series(day, greatest(day, coalesce(until, day)), INTERVAL 1 DAY)) AS date) AS d FROM shows) SELECT kind", 1))
def _(spark, sf):
    df = shows(spark, sf).withColumn("flags", F.when(F.col("venue").isNotNull(), F.col("categories")).otherwise(F.array().cast("array<string>"))).withColumnRenamed("day", "first")
    return R.diagnostics(FA.event_days(df.drop("start"), "first", "until"), "source", "flags")


@query("unflagged_sample", "A14", with_shows("SELECT seq FROM shows WHERE venue IS NULL ORDER BY seq LIMIT 10"))
def _(spark, sf):
    df = shows(spark, sf).withColumn("flags", F.when(F.col("venue").isNotNull(), F.col("categories")).otherwise(F.array().cast("array<string>")))
    return R.unflagged_sample(df, "flags", [F.asc("seq")]).select("seq")


@query("latency_percentiles", "A16", "SELECT event_type, round(quantile_cont(value, 0.50), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(spark, sf):
    return R.latency(table(spark, sf, "events"), ["event_type"], "value").select("event_type", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("price_percentiles", "A16", "SELECT round(quantile_cont(o_totalprice, 0.50), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders")
def _(spark, sf):
    return R.latency(table(spark, sf, "orders"), [], "o_totalprice").select(*[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")])


_HITS = "SELECT strftime(ts, '%Y-%m-%d') AS day, sum((event_type = 'view')::int) AS hits, sum((event_type = 'error')::int) AS misses, round(sum((event_type = 'view')::int) / nullif(sum((event_type IN ('view', 'error'))::int), 0), 4) AS hit_rate, quantile_cont(value, 0.95) FILTER (event_type = 'view') AS c95, quantile_cont(value, 0.95) FILTER (event_type = 'error') AS d95, avg(value) AS mean FROM events GROUP BY 1"


@query("hit_rates", "A17", f"SELECT day, hits, misses, coalesce(hit_rate, 0) AS hit_rate, round(mean, 4) AS mean_ms FROM ({_HITS})")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    return R.hit_rate(df, ["day"], F.col("event_type") == "view", F.col("event_type") == "error", "value").select("day", "hits", "misses", "hit_rate", "mean_ms")


@query("threshold_alerts", "A18 A16 A17", f"""WITH m AS ({_HITS}) SELECT day, 'low_hit_rate' AS type, 'warning' AS severity, hit_rate::double AS current, 0.6e0 AS threshold FROM m WHERE hits + misses >= 10 AND hit_rate < 0.6 UNION ALL SELECT day, 'high_cache_latency', 'warning', round(c95, 6), 120e0 FROM m WHERE c95 > 120
 UNION ALL SELECT day, 'high_db_latency', 'critical', round(d95, 6), 500e0 FROM m WHERE d95 > 500""")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    rates = R.hit_rate(df, ["day"], F.col("event_type") == "view", F.col("event_type") == "error", "value")
    p = R.exact_percentiles(df.where(F.col("event_type").isin("view", "error")), ["day", "event_type"], "value", {"p95": 0.95})
    per = p.groupBy("day").agg(F.max(F.when(F.col("event_type") == "view", F.col("p95"))).alias("cache_p95"), F.max(F.when(F.col("event_type") == "error", F.col("p95"))).alias("db_p95"))
    return R.threshold_alerts(rates.join(per, "day", "left")).withColumn("current", F.round("current", 6))


@query("id_fingerprint", "A19", with_places("SELECT flag, '\"' || md5(string_agg(id, ',' ORDER BY id)) || '\"' AS etag, 'W/\"' || md5(string_agg(id, ',' ORDER BY id)) || '\"' AS weak FROM (SELECT flag, id, row_number() OVER (PARTITION BY flag ORDER BY quality_score DESC, seq) AS r FROM (SELECT unnest(flags) AS flag, id, seq, quality_score FROM places)) WHERE r <= 100 GROUP BY 1"))
def _(spark, sf):
    top = FA.capped_by_flag(places(spark, sf), "flags", [F.desc("quality_score"), F.asc("seq")], "seq", 100)
    ids = top.groupBy("flag").agg(F.collect_list("id").alias("ids"))  # at most 100 ids per flag
    return ids.select("flag", K.ids_etag("ids").alias("etag"), K.ids_etag("ids", weak=True).alias("weak"))


@query("set_fingerprint", "A19", "SELECT event_type, count(*) AS n, bit_xor(h) AS fold_xor, sum(h % 1000000007)::bigint AS fold_sum FROM (SELECT DISTINCT event_type, event_id, ('0x' || substr(md5(event_id::varchar), 1, 15))::bigint AS h FROM events) GROUP BY 1")
def _(spark, sf):
    return FA.set_fingerprint(table(spark, sf, "events"), ["event_type"], "event_id")


@query("rolling_metrics", "W8 ST3", """WITH m AS (SELECT event_type, date_trunc('minute', ts) AS mi, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2), w AS (SELECT event_type, unnest(generate_series(mi - INTERVAL 14 MINUTE, mi, INTERVAL 1 MINUTE)) AS ws, n, s FROM m)
 SELECT event_type, strftime(ws, '%Y-%m-%d %H:%M') AS window_start, sum(n)::bigint AS n, round(sum(s), 4) AS total FROM w GROUP BY 1, 2""")
def _(spark, sf):
    out = R.rolling_counts(table(spark, sf, "events"), ["event_type"], "ts", "value")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", F.round("total", 4).alias("total"))


@query("change_statistics", "A11", with_places("SELECT count(*) AS \"rows\", sum((area <> trim(regexp_replace(area, '\\s+', ' ', 'g')))::int) AS fields_normalized, sum(length(area) - length(trim(regexp_replace(area, '\\s+', ' ', 'g')))) AS characters_removed, sum((area <> trim(regexp_replace(area, '\\s+', ' ', 'g')))::int) AS area_changed FROM places"))
def _(spark, sf):
    df = places(spark, sf).withColumn("clean", F.trim(F.regexp_replace("area", r"\s+", " ")))
    return R.change_statistics(df, {"area": ("area", "clean")})


@query("method_summary", "A12", "SELECT p_type AS method, count(*) AS n, round(avg(p_retailprice), 4) AS avg_confidence, min(p_retailprice) AS min_confidence, max(p_retailprice) AS max_confidence FROM part GROUP BY 1")
def _(spark, sf):
    return R.extraction_summary(table(spark, sf, "part"), "p_type", "p_retailprice").withColumnRenamed("p_type", "method")


@query("order_statistics", "A1 A2", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count_distinct("o_custkey").alias("customers"))
