"""Ranking, paging, top-N and week plans."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tagging as TG
from ..operators import facets as FA
from ..operators import filters as P
from ..operators import ranking as W
from ..sources import readers
from ..sources.readers import table
from .inputs import places, shows, with_places, with_shows
from .registry import query
from .score_q import COOL_SQL, scored_shows

J = lambda c: F.concat_ws("|", c)


@query("daily_topn", "W3", "SELECT day, position, event_id FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY cast(ts AS date) ORDER BY value DESC, event_id) AS position FROM events) WHERE position <= 6")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return W.day_cards(df, "day", [F.desc("value"), F.asc("event_id")]).select(F.col("day").cast("string").alias("day"), "position", "event_id")


@query("keep_first", "W2", with_places("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY lower(area), city ORDER BY seq) AS r FROM places) WHERE r = 1"))
def _(spark, sf):
    return W.keep_first(places(spark, sf).withColumn("a", F.lower("area")), ["a", "city"], [F.asc("seq")]).select("seq")


@query("latest_order_per_customer", "W1 W2", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(spark, sf):
    return W.keep_first(table(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderpriority"), F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("day_ranked_cards", "W4 F58 F59 P22", with_shows(COOL_SQL + "SELECT seq, position, position <= 3 AS is_top, round(boosted, 6) AS score FROM (SELECT seq, boosted, row_number() OVER (ORDER BY boosted DESC, seq) AS position FROM scored WHERE day = date '2024-01-10') WHERE position <= 200"))
def _(spark, sf):
    df = scored_shows(spark, sf).where("day = date '2024-01-10'")
    return W.mark_top(df, [F.desc("boosted"), F.asc("seq")], 200).select("seq", "position", "is_top", F.round("boosted", 6).alias("score"))


@query("top_percent", "W5", "SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders) WHERE rank < greatest(1, ceil((SELECT count(*) FROM orders) * 0.05))")
def _(spark, sf):
    return W.top_percent(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 0.05).select("o_orderkey", "rank")


@query("global_rank", "W5 W11", "SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS rank FROM part")
def _(spark, sf):
    return W.global_rank(table(spark, sf, "part"), "p_size", "p_partkey").select("p_partkey", "rank")


_WEEK = "SELECT *, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][slot] AS day FROM (SELECT title, source, tag_text, row_number() OVER (ORDER BY popularity DESC NULLS LAST, seq) AS slot FROM shows) WHERE slot <= 7"


@query("week_plan", "W6", with_shows(f"SELECT slot, day, 'evening' AS \"time\", title AS name, source FROM ({_WEEK})"))
def _(spark, sf):
    return W.plan_week(shows(spark, sf), [F.col("popularity").desc_nulls_last(), F.asc("seq")], "title", "source", "tags").drop("tags")


@query("week_plan_text", "F69", with_shows("""SELECT '=== WEEK PLAN: bangkok ===' || chr(10) || 'Tags: music, art' || chr(10) || string_agg(chr(10) || d || ':' || chr(10) || coalesce(line, '  - (free)'), chr(10) ORDER BY n) AS text
 FROM (SELECT unnest(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']) AS d, unnest(range(1, 8)) AS n) LEFT JOIN
 (SELECT row_number() OVER (ORDER BY popularity DESC NULLS LAST, seq) AS n, '  - Evening — ' || title || ' [' || array_to_string(tags, ', ') || '] (' || source || ')' AS line FROM shows QUALIFY n <= 7) p USING (n)"""))
def _(spark, sf):
    plan = W.plan_week(shows(spark, sf), [F.col("popularity").desc_nulls_last(), F.asc("seq")], "title", "source", "tags")
    return W.week_plan_text(plan, "bangkok", ["music", "art"])


@query("best_filled", "W7", with_shows("SELECT ent, seq FROM (SELECT ent, seq, row_number() OVER (PARTITION BY ent ORDER BY (coalesce(description, '') <> '')::int + (coalesce(venue, '') <> '')::int + (coalesce(image, '') <> '')::int DESC, seq) AS r FROM shows) WHERE r = 1"))
def _(spark, sf):
    return W.best_filled(shows(spark, sf), ["ent"], ["description", "venue", "image"], F.asc("seq")).select("ent", "seq")


@query("capped_union", "W9 U1 G13", with_shows("SELECT seq, title FROM (SELECT seq, title, row_number() OVER (PARTITION BY title, day, venue ORDER BY seq) AS r FROM shows WHERE source <> 'x') WHERE r = 1 ORDER BY seq LIMIT 60"))
def _(spark, sf):
    df = shows(spark, sf)
    parts = {s: df.where(F.col("source") == s) for s in ("other_site", "bk_magazine", "timeout_bkk")}
    return W.capped_union(readers.union_sources(parts), ["title", "day", "venue"], [F.asc("seq")], 60).select("seq", "title")


@query("sorted_lists", "W10 W12 W16", with_places("""
SELECT 'popularity' AS list, seq FROM (SELECT seq FROM places ORDER BY popularity DESC, seq LIMIT 20) UNION ALL SELECT 'quality', seq FROM (SELECT seq FROM places WHERE city = 'bangkok' ORDER BY quality_score DESC, seq LIMIT 10)
UNION ALL SELECT 'updated_at', seq FROM (SELECT seq FROM places ORDER BY updated_at DESC, seq LIMIT 20) UNION ALL SELECT 'name', seq FROM (SELECT seq FROM places WHERE price_level = 3 ORDER BY name, seq LIMIT 20)"""))
def _(spark, sf):
    df = places(spark, sf)
    lists = {"popularity": W.rank_by(df, "popularity", "seq", 20), "quality": W.rank_by(P.equal_to(df, city="bangkok"), "quality", "seq", 10),
             "updated_at": W.rank_by(df, "updated_at", "seq", 20), "name": W.rank_by(P.equal_to(df, price_level=3), "name", "seq", 20, descending=False)}
    out = None
    for name, rows in lists.items():
        one = rows.select(F.lit(name).alias("list"), "seq")
        out = one if out is None else out.unionByName(one)
    return out


@query("paged_sort", "W11", with_places("SELECT seq, (SELECT count(*) FROM places) AS total, 3 AS page, 100 < (SELECT count(*) FROM places) - 50 AS has_next, true AS has_prev FROM places ORDER BY quality_score DESC, seq LIMIT 50 OFFSET 100"))
def _(spark, sf):
    return W.page_of(places(spark, sf), W.sort_order("quality", "seq"), 3, 50).select("seq", "total", "page", "has_next", "has_prev")


@query("review_ranking", "W13", "SELECT s_suppkey, n FROM (SELECT s_suppkey, s_name, n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey) ORDER BY n DESC NULLS LAST, s_name LIMIT 20")
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "supplier").join(n, "s_suppkey", "left").orderBy(F.col("n").desc_nulls_last(), "s_name").limit(20).select("s_suppkey", "n")


@query("capped_per_flag", "W17 A29", with_places("SELECT flag, least(count(*), 100) AS n FROM (SELECT unnest(flags) AS flag FROM places) GROUP BY 1"))
def _(spark, sf):
    return FA.warmed(places(spark, sf), "flags", [F.desc("quality_score"), F.asc("seq")], "seq", 100)


@query("planned_candidates", "W18 F44", with_shows("""SELECT seq, score FROM (SELECT seq, CASE WHEN list_has_any(low, ['live music', 'music', 'concert', 'gig']) THEN 2 WHEN list_has_any(string_split(array_to_string(low, ' '), ' '), ['music', 'live', 'concert', 'gig']) THEN 1 ELSE 0 END
 + CASE WHEN list_has_any(low, ['art', 'exhibition', 'gallery']) THEN 2 ELSE 0 END AS score FROM (SELECT seq, list_transform(tags, lambda t: lower(t)) AS low FROM shows)) WHERE score > 0 ORDER BY score DESC, seq LIMIT 300"""))
def _(spark, sf):
    score = TG.tag_match_score(F.lit("music"), "tags") + TG.tag_match_score(F.lit("art"), "tags")
    return W.first_rows(shows(spark, sf).select("seq", score.alias("score")).where("score > 0"), [F.desc("score"), F.asc("seq")], 300)


@query("images_first", "W19", with_shows("SELECT seq, position FROM (SELECT seq, row_number() OVER (PARTITION BY ent ORDER BY coalesce(image, '') = '', seq) AS position FROM shows)"))
def _(spark, sf):
    from ..operators.extract import images_first
    return images_first(shows(spark, sf).withColumn("image_url", F.col("image")), "ent", F.asc("seq")).select("seq", "position")
