"""Facet index, calendars, freshness, ingest run."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import tagging as TG
from ..operators import facets as FA
from ..operators import filters as P
from ..plans import ingest as PI
from ..sources.readers import table
from . import sqltext as S
from .inputs import places, shows, with_shows
from .registry import query
from .. import rules

J = lambda c: F.concat_ws("|", c)


def _flagged(spark, sf):
    return shows(spark, sf).withColumn("flags", TG.true_keys(TG.text_attributes("title", "description")))


_FLAGS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {S.has('''lower(title || ' ' || coalesce(description, ''))''', w)} THEN {S.q(n)} END" for n, w in sorted(rules.ATTRIBUTE_WORDS.items())) + "], lambda x: x IS NOT NULL)"
FACET_SQL = f", f AS (SELECT seq, city, cast(day AS varchar) AS day, id, {_FLAGS_SQL} AS flags, categories FROM shows), rows AS (SELECT DISTINCT city, day, 'category' AS kind, lower(unnest(categories)) AS key, id FROM f UNION ALL SELECT DISTINCT city, day, 'flag', unnest(flags), id FROM f) "


def _rows(spark, sf):
    return FA.facet_rows(_flagged(spark, sf), "city", "day", "id", "categories", "flags")


@query("facet_index", "A20 S19", with_shows(FACET_SQL + "SELECT city, day, kind, key, id FROM rows"))
def _(spark, sf):
    return _rows(spark, sf).withColumn("day", F.col("day").cast("string"))


@query("facet_chunks", "A20 A31", with_shows(FACET_SQL + "SELECT kind, key, count(*) AS total FROM rows GROUP BY 1, 2"))
def _(spark, sf):
    chunks = FA.facet_chunks(_rows(spark, sf), 20)
    return chunks.groupBy("kind", "key").agg(F.sum(F.size("ids")).alias("total"))


@query("facet_day_index", "A21", with_shows(FACET_SQL + "SELECT city, day, string_agg(key || '=' || n, '|' ORDER BY key) AS flags FROM (SELECT city, day, key, count(*) AS n FROM rows WHERE kind = 'flag' GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def _(spark, sf):
    text = F.transform(F.array_sort(F.map_entries("flags")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return FA.day_index(_rows(spark, sf)).select("city", F.col("day").cast("string").alias("day"), J(text).alias("flags"))


@query("facet_days_complete", "J17 C3", with_shows(FACET_SQL + """, c AS (SELECT DISTINCT city, kind, key FROM rows), n AS (SELECT city, kind, key, day, count(*) AS n FROM rows GROUP BY ALL)
 SELECT c.city, c.kind, c.key, cast(d AS varchar) AS day, coalesce(n, 0) AS n FROM c CROSS JOIN (SELECT cast(unnest(generate_series(date '2024-01-01', date '2024-02-09', INTERVAL 1 DAY)) AS date) AS d) LEFT JOIN n ON n.city = c.city AND n.kind = c.kind AND n.key = c.key AND n.day = cast(d AS varchar)"""))
def _(spark, sf):
    days = FA.calendar(spark, dt.date(2024, 1, 1), 40)
    out = FA.complete_days(FA.facet_counts(_rows(spark, sf)), days, ["city", "kind", "key"])
    return out.withColumn("day", F.col("day").cast("string"))


@query("facet_missing", "J18", with_shows(FACET_SQL + "SELECT city, day, count(*) AS db_rows FROM f WHERE (city, day) NOT IN (SELECT city, day FROM rows WHERE kind = 'flag' AND key = 'rooftop') GROUP BY 1, 2"))
def _(spark, sf):
    index = _rows(spark, sf).where("kind = 'flag' and key = 'rooftop'")
    return FA.missing_in_index(shows(spark, sf), index, ["city", "day"]).withColumn("day", F.col("day").cast("string"))


@query("facet_freshness", "C1 ST6", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN age <= 7200 THEN 'fresh' WHEN age <= 9000 THEN 'stale' ELSE 'miss' END AS state FROM (SELECT floor(epoch(timestamp '2024-01-15 12:00:00')) - floor(epoch(ts)) AS age FROM events)) GROUP BY 1")
def _(spark, sf):
    state = FA.freshness_state("ts", F.lit("2024-01-15 12:00:00"), 7200, 1800)
    return table(spark, sf, "events").select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("facet_fallback", "C2", """WITH u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' AND user_id % 3 = 0 GROUP BY 1), s AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
 SELECT u.user_id, coalesce(h.n, s.n, b.n) AS n, CASE WHEN h.n IS NOT NULL THEN 'hit' WHEN s.n IS NOT NULL THEN 'stale' WHEN b.n IS NOT NULL THEN 'refresh' ELSE 'empty' END AS status FROM u LEFT JOIN h USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN b USING (user_id)""")
def _(spark, sf):
    e = table(spark, sf, "events")

    def counts(kind, test="true"):
        return e.where(F.col("event_type") == kind).where(test).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return FA.lookup_with_fallback(e.select("user_id").distinct(), counts("view", "user_id % 3 = 0"), counts("click", "user_id % 2 = 0"), counts("signup"), ["user_id"], "n")


@query("facet_rebuild", "C3 C4 J16", with_shows(f""", r AS (SELECT city, id, cast(unnest(generate_series(day, coalesce(until, day), INTERVAL 1 DAY)) AS date) AS d, {_FLAGS_SQL} AS flags FROM shows WHERE until IS NULL OR until >= day), n AS (SELECT city, d, key, count(DISTINCT id) AS n FROM (SELECT city, d, id, unnest(flags) AS key FROM r) GROUP BY 1, 2, 3)
 SELECT g.city, cast(g.d AS varchar) AS day, g.key, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT city FROM shows), (SELECT cast(unnest(generate_series(date '2024-01-10', date '2024-01-23', INTERVAL 1 DAY)) AS date) AS d), (SELECT unnest(['rooftop', 'market', 'culture']) AS key)) g LEFT JOIN n USING (city, d, key)"""))
def _(spark, sf):
    out = FA.rebuild(_flagged(spark, sf).drop("start").withColumnRenamed("day", "start"), "city", "start", "until", "id", "flags", ["rooftop", "market", "culture"], dt.date(2024, 1, 10), 14)
    return out.withColumn("day", F.col("day").cast("string"))


@query("facet_invalidated", "S20", with_shows(FACET_SQL + "SELECT city, kind, key, count(*) AS n FROM rows WHERE NOT (city = 'phuket' AND key IN ('food', 'rooftop')) GROUP BY 1, 2, 3"))
def _(spark, sf):
    return FA.invalidate(_rows(spark, sf), "phuket", ["food", "rooftop"]).groupBy("city", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


@query("event_calendar", "J16 U6", """SELECT cast(d AS varchar) AS day, count(*) AS n FROM (SELECT cast(unnest(generate_series(cast(o_orderdate AS date), cast(o_orderdate AS date) + (o_orderkey % 4)::int, INTERVAL 1 DAY)) AS date) AS d FROM orders) GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("last", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 4).cast("int")))
    return FA.event_days(o, "o_orderdate", "last").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("interval_overlap", "P10 J16", """SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE greatest(o_orderdate, timestamp '1998-01-01') <= least(l_shipdate, timestamp '1998-03-31') GROUP BY 1""")
def _(spark, sf):
    from ..functions import dates as D
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    lo, hi = F.lit("1998-01-01").cast("date"), F.lit("1998-03-31").cast("date")
    return j.where(D.ranges_overlap(F.to_date("o_orderdate"), F.to_date("l_shipdate"), lo, hi)).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_run", "PL3 P13 W5 S12 S17 A20", with_shows(f""", k AS (SELECT * FROM shows WHERE day BETWEEN date '2024-01-05' AND date '2024-01-09' AND trim(url) <> ''), lim AS (SELECT greatest(1, ceil(count(*) * 0.2)) AS l FROM k), top AS (SELECT *, row_number() OVER (ORDER BY value DESC, seq) - 1 < (SELECT l FROM lim) AS in_top FROM k)
 SELECT source, count(*) AS n, sum(in_top::int) AS n_top FROM top GROUP BY 1"""))
def _(spark, sf):
    batch = shows(spark, sf).withColumn("score", F.col("value")).withColumn("attrs", TG.text_attributes("title", "description"))
    run = PI.ingest_run(batch, None, dt.date(2024, 1, 5), 4, 0.2)
    return run["events"].groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("raw_html_ref").alias("n_top"))


@query("ingest_facets", "PL3 A20", with_shows(FACET_SQL.replace("FROM shows)", "FROM shows WHERE day BETWEEN date '2024-01-05' AND date '2024-01-09' AND trim(url) <> '')") + "SELECT city, day, kind, key, count(*) AS n FROM rows GROUP BY 1, 2, 3, 4"))
def _(spark, sf):
    batch = shows(spark, sf).withColumn("score", F.col("value")).withColumn("attrs", TG.text_attributes("title", "description"))
    run = PI.ingest_run(batch, None, dt.date(2024, 1, 5), 4, 0.2)
    return FA.facet_counts(run["facets"]).withColumn("day", F.col("day").cast("string"))
