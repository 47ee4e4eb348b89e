"""Filters, predicates and projections."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import rules
from ..functions import html as H
from ..functions import tagging as TG
from ..operators import filters as P
from ..operators import tables as T
from ..sources.readers import table
from . import sqltext as S
from .inputs import pick, places, shows, with_places, with_shows
from .registry import query


@query("places_filtered", "P1 P2 P3", with_places("""
SELECT seq, id, city, price_level FROM places WHERE city = 'bangkok' AND price_level = 2 AND list_has_any(flags, ['art_exhibits', 'rooftop'])"""))
def _(spark, sf):
    df = P.equal_to(places(spark, sf), city="bangkok", price_level=2, source=None)
    return P.any_flag(df, ["art_exhibits", "rooftop"]).select("seq", "id", "city", "price_level")


@query("shows_by_category", "P4 P6", with_shows("""
SELECT seq, id FROM shows WHERE list_contains(list_transform(categories, lambda c: lower(c)), 'bars') AND start = timestamp '2024-01-07'"""))
def _(spark, sf):
    df = P.in_category(shows(spark, sf), "BARS")
    return P.on_day(df.withColumn("start", F.col("start").cast("timestamp_ntz")), "start", dt.date(2024, 1, 7)).select("seq", "id")


@query("shows_with_attribute", "P5 F42", with_shows("SELECT seq, id FROM shows WHERE " + S.has("lower(title || ' ' || coalesce(description, ''))", rules.ATTRIBUTE_WORDS["rooftop"])))
def _(spark, sf):
    df = shows(spark, sf).withColumn("attrs", TG.text_attributes("title", "description"))
    return P.with_attribute(df, "rooftop").select("seq", "id")


@query("events_between_days", "P6 P7", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE cast(ts AS date) BETWEEN date '2024-01-05' AND date '2024-01-09' GROUP BY 1""")
def _(spark, sf):
    df = P.between_days(table(spark, sf, "events"), "ts", dt.date(2024, 1, 5), dt.date(2024, 1, 9))
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("city_contains", "P8", with_places("SELECT city, count(*) AS n FROM places WHERE city ILIKE '%NG%' GROUP BY 1"))
def _(spark, sf):
    return P.city_like(places(spark, sf), "NG").groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query("drop_reasons", "P13 A30", with_shows("""
SELECT source, coalesce(CASE WHEN start IS NULL THEN 'no_start' WHEN NOT (day BETWEEN date '2024-01-03' AND date '2024-01-20') THEN 'out_of_range' WHEN trim(url) = '' THEN 'no_url' END, 'kept') AS reason, count(*) AS n
FROM shows GROUP BY 1, 2"""))
def _(spark, sf):
    reason = P.drop_reason("start", "url", F.lit("2024-01-03").cast("date"), F.lit("2024-01-20").cast("date"))
    return shows(spark, sf).groupBy("source", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("keyword_filter", "P14", with_shows("SELECT seq FROM shows WHERE " + S.has("lower(title || ' ' || coalesce(description, ''))", ["market", "festival", "yoga"])))
def _(spark, sf):
    return P.with_words(shows(spark, sf), ["Market", "festival", "yoga"], "title", "description").select("seq")


@query("recipe_valid_rows", "P15", with_places("SELECT seq FROM places WHERE coalesce(name, '') <> '' AND coalesce(domain, '') <> '' AND length(name) BETWEEN 5 AND 28 AND (coalesce(description, '') = '' OR length(description) >= 40)"))
def _(spark, sf):
    return places(spark, sf).where(P.recipe_valid(["name", "domain"], 5, 28, 40)).select("seq")


@query("text_looks_like_place", "P18 P19", with_places(f"""
SELECT seq, length(name) BETWEEN 3 AND 100 AND {S.has('lower(name)', rules.PLACE_NAME_WORDS)} AS looks, coalesce(length(description) >= 50 AND {S.has('lower(description)', rules.PLACE_INFO_WORDS)}, false) AS info,
 NOT {S.has('lower(name)', rules.HEADING_DENY)} AND length(name) > 5 AND length(name) < 100 AS heading, NOT {S.has('lower(name)', rules.ALT_DENY)} AND length(name) > 5 AS alt FROM places"""))
def _(spark, sf):
    return places(spark, sf).select("seq", H.looks_like_place_name("name").alias("looks"), H.contains_place_info("description").alias("info"), P.good_heading("name").alias("heading"), P.good_alt("name", "url").alias("alt"))


@query("include_exclude", "P23", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?:^red)|(?:gear$)') AND NOT regexp_matches(p_name, '(?:widget)')")
def _(spark, sf):
    return P.include_exclude(table(spark, sf, "part"), "p_name", ["^red", "gear$"], ["widget"]).select("p_partkey")


@query("card_fields", "P22", with_shows("SELECT title, cast(day AS varchar) AS day, venue, source, url FROM shows WHERE price_min = 0"))
def _(spark, sf):
    return shows(spark, sf).where("price_min = 0").select("title", F.col("day").cast("string").alias("day"), "venue", "source", "url")


@query("source_scan", "S3", with_places("SELECT seq, id, cast(updated_at AS varchar) AS updated_at FROM places WHERE source = 'guide_b' ORDER BY places.updated_at DESC, seq LIMIT 100"))
def _(spark, sf):
    df = P.by_source(places(spark, sf), "guide_b", [F.desc("updated_at"), F.asc("seq")])
    return df.select("seq", "id", F.col("updated_at").cast("string").alias("updated_at"))


@query("point_lookup", "S4", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77")
def _(spark, sf):
    return P.by_id(table(spark, sf, "customer"), 77, "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query("event_scan", "S5", with_shows("SELECT seq, title FROM shows WHERE category_text ILIKE '%art%' OR tag_text ILIKE '%art%' ORDER BY start, seq LIMIT 200"))
def _(spark, sf):
    return P.events_like(shows(spark, sf), "art", [F.asc("start"), F.asc("seq")], 200).select("seq", "title")


@query("schema_tolerant", "S9", "SELECT cast(o_orderkey AS varchar) AS id, cast(o_totalprice AS varchar) AS amount, cast(NULL AS varchar) AS note FROM orders")
def _(spark, sf):
    df = T.pick_columns(table(spark, sf, "orders"), {"id": ["id", "order_id", "O_ORDERKEY"], "amount": ["amount", "o_totalprice"], "note": ["note", "comment"]})
    return df.select(F.col("id").cast("string").alias("id"), F.col("amount").cast("string").alias("amount"), "note")


@query("validated_rows", "S10 S11", with_shows("""
SELECT seq, coalesce(nullif(src, ''), 'feed') AS source FROM (SELECT *, CASE WHEN seq % 5 = 0 THEN '' ELSE source END AS src FROM shows) WHERE trim(url) <> '' AND coalesce(venue, '') <> '' ORDER BY seq LIMIT 500"""))
def _(spark, sf):
    df = shows(spark, sf).withColumn("source", F.when(F.col("seq") % 5 == 0, F.lit("")).otherwise(F.col("source")))
    good, _ = T.validate_rows(df, ["title", "url", "venue"], "feed", [F.asc("seq")], 500)
    return good.select("seq", "source")


@query("validation_counts", "S10", with_shows("SELECT CASE WHEN trim(url) = '' THEN 'missing_url' WHEN coalesce(venue, '') = '' THEN 'missing_venue' ELSE 'ok' END AS reason, count(*) AS \"count\" FROM shows GROUP BY 1"))
def _(spark, sf):
    return T.validation_counts(shows(spark, sf), ["title", "url", "venue"])


@query("price_area_words", "F65 J8", with_places("SELECT seq, " + S.ladder("lower(coalesce(address, ''))", [(a.title(), [a]) for a in rules.AREAS_IN_ADDRESS]) + " AS area_in_address, "
       + S.ladder("lower(name || ' ' || area)", [(a, [a.lower()]) for a in rules.AREAS_IN_TEXT]) + " AS area_in_text FROM places"))
def _(spark, sf):
    return places(spark, sf).select("seq", TG.first_listed("address", rules.AREAS_IN_ADDRESS, title=True).alias("area_in_address"), TG.first_listed(F.concat_ws(" ", "name", "area"), rules.AREAS_IN_TEXT).alias("area_in_text"))


_BADGE = "Must-see|new|Hot!|"


@query("title_words", "F66 F67 F68 F70", with_shows(f"""
SELECT seq, CASE WHEN {S.has(f"lower({pick(_BADGE, 'ent')})", rules.PICK_BADGES)} OR {S.has("lower(concat_ws(' ', title, description))", rules.PICK_WORDS)} THEN 'Picks' ELSE '' END AS pick,
 {S.ladder('lower(title)', rules.TITLE_HINTS, S.q, "'events'")} AS hint, array_to_string(list_filter([{', '.join(f"CASE WHEN {S.has('lower(title)', w)} THEN {S.q(t)} END" for t, w in rules.TITLE_TAGS)}], lambda x: x IS NOT NULL), '|') AS title_tags,
 CASE WHEN {S.has('lower(category_text)', rules.EVENING_CATEGORIES)} THEN 'evening' ELSE 'day' END AS typical_time, coalesce(image, CASE WHEN regexp_matches(lower(category_text), 'food|restaurant') THEN 'food.jpg' WHEN contains(lower(category_text), 'bar') THEN 'bar.jpg' WHEN regexp_matches(lower(category_text), 'park|outdoor') THEN 'park.jpg' ELSE 'city.jpg' END) AS shown_image FROM shows"""))
def _(spark, sf):
    return shows(spark, sf).select("seq", F.array_join(TG.pick_tags(F.expr(pick(_BADGE, "ent")), "title", "description"), "|").alias("pick"), TG.title_hint("title").alias("hint"),
                                   F.array_join(TG.title_tags("title"), "|").alias("title_tags"), TG.typical_time("category_text").alias("typical_time"), TG.shown_image("image", "category_text").alias("shown_image"))
