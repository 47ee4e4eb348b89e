"""Text, key, url and date columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import dates as D
from ..functions import geo as G
from ..functions import keys as K
from ..functions import text as X
from ..functions import urls as U
from ..operators import normalize as N
from ..operators import reports as R
from ..sources.readers import table
from . import sqltext as S
from .inputs import pick, places, shows, web, with_places, with_shows, with_web
from .lookup_q import AREA_SQL, area_dim
from .registry import query

J = lambda c: F.concat_ws("|", c)


@query("text_normalised", "F1 F3", f"SELECT doc_id, md5({S.norm('text')}) AS h, md5(lower({S.norm('text')})) AS tag_h, length({S.norm('text')}) AS n FROM documents")
def _(spark, sf):
    n = X.normalize_text("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(n).alias("h"), F.md5(X.norm_tag("text")).alias("tag_h"), F.length(n).cast("long").alias("n"))


@query("text_truncated", "F2 F10", """
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE concat(rtrim(regexp_replace(substr(text, 1, 120), ' [^ ]*$', ''), ' ' || chr(10) || chr(13) || chr(9)), '…') END AS short,
       length(text) > 4000 AS was_cut FROM documents""")
def _(spark, sf):
    _, full = X.long_description("text")
    return table(spark, sf, "documents").select("doc_id", X.safe_truncate("text", 120).alias("short"), full.isNotNull().alias("was_cut"))


@query("text_title_case", "F25", with_places("""
SELECT seq, array_to_string(list_transform(regexp_split_to_array(trim(lower(area || ' of the ' || name)), '\\s+'), lambda w, i:
  CASE WHEN i > 1 AND w IN (""" + ", ".join(S.q(w) for w in rules.SMALL_WORDS) + """) THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ') AS title FROM places"""))
def _(spark, sf):
    return places(spark, sf).select("seq", X.title_case(F.concat("area", F.lit(" of the "), "name")).alias("title"))


def _abbr(e, table_):
    for short, full in table_.items():
        e = f"regexp_replace({e}, '(?i)\\b{short}\\b\\.?', '{full}', 'g')"
    return e


@query("text_abbreviations", "F26", with_places(
    f"SELECT seq, {_abbr('address', rules.ABBREVIATIONS)} AS base, {_abbr('address', {**rules.ABBREVIATIONS, **rules.CITY_ABBREVIATIONS})} AS city FROM places WHERE address IS NOT NULL"))
def _(spark, sf):
    return places(spark, sf).where("address is not null").select("seq", X.expand_abbreviations("address").alias("base"), X.expand_abbreviations("address", city=True).alias("city"))


_DESC = r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(description, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s\-.,!?()&]', '', 'g'), '\.{2,}', '.', 'g'), '-{2,}', '-', 'g')"


def _removed(e, patterns):
    for p in patterns:
        e = f"regexp_replace({e}, {S.q('(?i)' + p)}, '', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


@query("text_cleaned", "F27 F29", with_places(f"SELECT seq, {_DESC} AS cleaned, {_removed(_DESC, rules.DESCRIPTION_CLEANUP)} AS plain, {_removed('area', rules.AREA_CLEANUP)} AS area FROM places WHERE description IS NOT NULL"))
def _(spark, sf):
    return places(spark, sf).where("description is not null").select("seq", N.clean_description("description").alias("cleaned"),
                                                                     X.remove_patterns(N.clean_description("description"), rules.DESCRIPTION_CLEANUP).alias("plain"), X.remove_patterns("area", rules.AREA_CLEANUP).alias("area"))


@query("tags_cleaned", "F28 F4", with_places(r"""
SELECT seq, array_to_string(list_transform(list_distinct_ordered, lambda t: replace(regexp_replace(t, '[^a-z0-9_\s\-]', '', 'g'), ' ', '-')), '|') AS tags,
  array_to_string(list_transform(list_distinct_ordered, lambda t: replace(regexp_replace(t, '[^a-z0-9_\s\-]', '', 'g'), ' ', '_')), '|') AS flags,
  array_to_string(list_distinct_ordered, '|') AS uniq
FROM (SELECT seq, list_filter(low, lambda t, i: list_position(low, t) = i) AS list_distinct_ordered FROM (SELECT seq, list_transform(tags, lambda t: lower(trim(t))) AS low FROM places))"""))
def _(spark, sf):
    return places(spark, sf).select("seq", J(X.tag_list("tags", "-")).alias("tags"), J(X.tag_list("tags", "_")).alias("flags"), J(X.unique_list("tags")).alias("uniq"))


@query("match_forms", "F18 F19 F20", with_places(f"SELECT seq, {S.match_name('name')} AS name_form, {S.match_address('address')} AS address_form, length(name) BETWEEN 2 AND 200 AS name_ok FROM places"))
def _(spark, sf):
    return places(spark, sf).select("seq", X.match_name("name").alias("name_form"), X.match_address("address").alias("address_form"), X.valid_name("name")[1].alias("name_ok"))


@query("identity_keys", "F14 F15 F16 F17", with_places(f"""
SELECT seq, {S.match_key()} AS match_key,
 regexp_replace(regexp_replace(lower(name || '-' || city), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '::www.example.com' ||
   CASE WHEN geo_lat IS NOT NULL THEN '::' || {S.fixed3('geo_lat')} || '_' || {S.fixed3('geo_lng')} ELSE '' END AS place_identity,
 concat_ws('_', lower(name), city, source, lower(area), CASE WHEN geo_lat IS NOT NULL THEN {S.fixed3('geo_lat')} END, CASE WHEN geo_lat IS NOT NULL THEN {S.fixed3('geo_lng')} END) AS place_key,
 substr(md5(name || ':' || url), 1, 12) AS short_id, substr(sha256(url), 1, 16) AS url_id FROM places"""))
def _(spark, sf):
    return places(spark, sf).select("seq", K.match_key("name", "city", "domain", "geo_lat", "geo_lng").alias("match_key"), K.place_identity("name", "city", "url", "geo_lat", "geo_lng").alias("place_identity"),
                                    K.place_key("name", "city", "source", "area", "geo_lat", "geo_lng").alias("place_key"), K.short_md5("name", "url").alias("short_id"), K.url_id("url").alias("url_id"))


@query("event_identity", "F13", with_shows(f"SELECT seq, sha256(lower({S.norm('title')}) || '|' || strftime(start, '%Y-%m-%d') || '|' || coalesce({S.norm('venue')}, '')) AS identity FROM shows"))
def _(spark, sf):
    return shows(spark, sf).select("seq", K.event_identity("title", "start", "venue").alias("identity"))


@query("url_forms", "F5 F6 F7", with_web(r"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://host.example/' || cast(page_id AS varchar) WHEN page_id % 3 = 1 THEN 'https://host.example/x' ELSE url END AS fixed,
 lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS domain,
 regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/img/a.png' AS root_image,
 CASE WHEN url LIKE '%/search?%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/search/b.png' ELSE url || '/b.png' END AS near_image FROM web"""))
def _(spark, sf):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("//host.example/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.lit(" host.example/x ")).otherwise(F.col("url"))
    return web(spark, sf).select("page_id", U.normalize_url(raw).alias("fixed"), U.domain_of("url").alias("domain"), U.absolute_url(F.lit("/img/a.png"), "url").alias("root_image"), U.absolute_url(F.lit("b.png"), "url").alias("near_image"))


_LOOSE = "yes|0|No|1|off|maybe|2.5|TRUE||none"


@query("loose_values", "F8 F9 F11 F12 F64", f"""
SELECT p_partkey, CASE WHEN w IN ('', 'no', 'off', '0', 'none') THEN false ELSE true END AS flag, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_retailprice END AS number,
 CASE WHEN p_size BETWEEN 1 AND 30 THEN p_size * 3.0 END AS lat, least(greatest(p_size - 10, 0), 4) AS price_level,
 CASE p_size % 6 WHEN 0 THEN 'budget' WHEN 1 THEN 'budget' WHEN 4 THEN 'high_end' ELSE 'mid_range' END AS band
FROM (SELECT *, lower({pick(_LOOSE, 'p_partkey')}) AS w FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    text = F.when(F.col("p_size") % 9 == 0, F.lit("n/a")).otherwise(F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))
    return p.select("p_partkey", X.loose_bool(F.expr(pick(_LOOSE, "p_partkey"))).alias("flag"), X.parse_number(text).alias("number"),
                    G.clean_latitude(F.col("p_size") * 3.0).alias("lat"), G.clamp_price_level(F.col("p_size") - 10).alias("price_level"), G.provider_price(F.col("p_size") % 6).alias("band"))


@query("normalisation_check", "F30 A11", with_places(f"""
SELECT count(*) AS "rows", sum(cast(description IS NOT NULL AND {_DESC} <> description AS int)) AS description_changed,
  sum(cast(coalesce(description, '') = '' AS int)) AS missing_description, sum(cast(regexp_matches(coalesce(description, ''), '[<>]') AS int)) AS html_left,
  sum(greatest(length(coalesce(description, '')) - length(coalesce({_DESC}, '')), 0)) AS characters_removed FROM places"""))
def _(spark, sf):
    df = places(spark, sf).withColumn("cleaned", N.clean_description("description"))
    c = N.check_normalized()
    counts = R.change_statistics(df, {"description": ("description", "cleaned")}).select("rows", "description_changed", "characters_removed")
    marks = df.agg(F.count_if(F.array_contains(c["warnings"], "Missing or empty description")).alias("missing_description"), F.count_if(F.array_contains(c["errors"], "HTML tags found in description")).alias("html_left"))
    return counts.withColumn("_k", F.lit(1)).join(marks.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _titled(e):
    words = f"regexp_split_to_array(trim(lower(trim(regexp_replace(regexp_replace({e}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')))), '\\s+')"
    small = ", ".join(S.q(w) for w in rules.SMALL_WORDS)
    return _abbr(f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i > 1 AND w IN ({small}) THEN w ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')", rules.ABBREVIATIONS)


_CLEAN_TAG = "array_to_string(list_transform(list_filter(list_transform({c}, lambda t: lower(trim(t))), lambda t, i: list_position(list_transform({c}, lambda u: lower(trim(u))), t) = i), lambda t: replace(regexp_replace(t, '[^a-z0-9_\\s\\-]', '', 'g'), ' ', '{to}')), '|')"
_LISTS = f"{_CLEAN_TAG.format(c='tags', to='-')} AS tags, {_CLEAN_TAG.format(c='flags', to='_')} AS flags"


@query("normalised_places", "PL5 UD1 F27", with_places(f"SELECT seq, {_titled('name')} AS name, {_removed(_DESC, rules.DESCRIPTION_CLEANUP)} AS description, {_removed(_titled('area'), rules.AREA_CLEANUP)} AS area, {_LISTS} FROM places"))
def _(spark, sf):
    return N.Normalizer()(places(spark, sf)).select("seq", "name", "description", "area", J("tags").alias("tags"), J("flags").alias("flags"))


@query("normalised_by_city", "PL5 UD1 J9", with_places(", " + AREA_SQL + f""", b AS (SELECT seq, {_titled('name')} AS name, {_titled('area')} AS area, {_removed(_DESC, rules.DESCRIPTION_CLEANUP)} AS description FROM places),
 sp AS (SELECT DISTINCT lower(trim(area)) AS a FROM b), ex AS (SELECT a, arg_min(d.area, ord) AS std FROM sp JOIN area_dim d ON a = synonym GROUP BY a),
 pt AS (SELECT a, arg_min(d.area, ord) AS std FROM sp JOIN area_dim d ON contains(a, synonym) OR contains(synonym, a) GROUP BY a),
 f AS (SELECT seq, name, description, area AS was, coalesce(upper(substr(coalesce(ex.std, pt.std), 1, 1)) || substr(coalesce(ex.std, pt.std), 2), area) AS area FROM b LEFT JOIN ex ON ex.a = lower(trim(area)) LEFT JOIN pt ON pt.a = lower(trim(area)))
 SELECT seq, name, description, {_removed('area', rules.AREA_CLEANUP)} AS area, was FROM f"""))
def _(spark, sf):
    """City rules as a step of the chain, with the phrases switched off that they stand for; the original area is kept."""
    chain = N.Normalizer().with_step("keep", lambda d: d.withColumn("was", F.col("area"))).with_step("city", N.city_step(area_dim(spark)))
    return chain.enable("phrases", False)(places(spark, sf)).select("seq", "name", "description", "area", "was")


@query("recipe_cleaning", "F31 F63", with_places(r"""
SELECT seq, regexp_replace(name, '^-\s*', '') AS trimmed, CASE WHEN length(description) > 30 THEN substr(description, 1, 27) || '...' ELSE description END AS cut,
 """ + S.ladder("lower(coalesce(description, '') || ' ' || name)", rules.PRICE_WORDS_RECIPE, str) + " AS price_level, " + S.ladder("lower(coalesce(description, ''))", rules.PRICE_WORDS_PROSE, str, "2") + " AS prose_level, "
    + S.ladder("lower(coalesce(description, ''))", rules.PRICE_WORDS_PAGE, str, "2") + " AS page_level FROM places"))
def _(spark, sf):
    from ..functions.tagging import price_from_words
    df = places(spark, sf)
    return df.select("seq", X.trim_bullets(F.concat(F.lit("- "), "name")).alias("trimmed"), X.cut_with_dots("description", 30).alias("cut"),
                     price_from_words(F.concat(F.coalesce("description", F.lit("")), F.lit(" "), "name")).alias("price_level"),
                     price_from_words("description", rules.PRICE_WORDS_PROSE, 2).alias("prose_level"), price_from_words("description", rules.PRICE_WORDS_PAGE, 2).alias("page_level"))


@query("tokens_and_stems", "F32 F23", r"""
WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, len(list_distinct(w)) AS n_tokens,
 array_to_string(list_sort(list_distinct(list_transform(w, lambda x: CASE WHEN length(x) > 3 AND x LIKE '%ies' THEN substr(x, 1, length(x) - 3) || 'y' WHEN length(x) > 2 AND x LIKE '%es' THEN substr(x, 1, length(x) - 2)
   WHEN length(x) > 1 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN substr(x, 1, length(x) - 1) ELSE x END))), ' ') AS stems FROM t""")
def _(spark, sf):
    t = X.tokens_en("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.array_sort(F.array_distinct(F.transform(t, X.stem_en))), " ").alias("stems"))


@query("search_text", "F21 F35", with_places("SELECT seq, concat_ws(' ', name, nullif(description, ''), nullif(area, ''), array_to_string(tags, ' ')) AS txt, coalesce(nullif(trim(image_url), ''), nullif(trim(website), ''), url) AS link FROM places"))
def _(spark, sf):
    return places(spark, sf).select("seq", X.search_text("name", "description", "area", tags="tags").alias("txt"), X.first_filled("image_url", "website", "url").alias("link"))


@query("index_keys", "F34", with_places("""
SELECT seq, 'v2:' || city || ':' || cast(updated_at AS varchar) || ':flag:' || flags[1] AS flag_key, 'v2:' || city || ':' || cast(updated_at AS varchar) || ':index' AS index_key,
 'places:' || city || ':query:' || substr(md5(name), 1, 8) || ':limit:50' AS query_key FROM places"""))
def _(spark, sf):
    return places(spark, sf).select("seq", K.flag_key("city", "updated_at", F.col("flags")[0]).alias("flag_key"), K.index_key("city", "updated_at").alias("index_key"), K.query_key("city", F.lit(""), "name", F.lit(50)).alias("query_key"))


@query("maps_links", "F33", with_places("""
SELECT seq, 'https://www.google.com/maps/search/?api=1&query=' || url_encode(concat_ws(' ', name, nullif(address, ''), 'Bangkok, Thailand')) ||
  CASE WHEN geo_lat <> 0 AND geo_lng <> 0 THEN '&ll=' || geo_lat::varchar || ',' || geo_lng::varchar ELSE '' END AS link FROM places"""))
def _(spark, sf):
    return places(spark, sf).select("seq", U.maps_search_url("name", "address", "geo_lat", "geo_lng").alias("link"))


_WORDS = "CASE " + " ".join(f"WHEN contains(lower(name), '{d}') OR contains(lower(coalesce(address, '')), '{d}') THEN {{'lat': {la}, 'lng': {ln}, 'd': '{d}'}}" for d, la, ln, _ in rules.DISTRICTS) \
    + f" ELSE {{'lat': {rules.CENTER[0]}, 'lng': {rules.CENTER[1]}, 'd': 'centre'}} END"


@query("coordinates_completed", "J15 PL4", with_places(f"""SELECT seq, round(coalesce(geo_lat, w.lat)::double, 6) AS lat, round(coalesce(geo_lng, w.lng)::double, 6) AS lng, CASE WHEN geo_lat IS NULL THEN w.d ELSE 'given' END AS geo_source
 FROM (SELECT *, {_WORDS} AS w FROM places)"""))
def _(spark, sf):
    from ..plans.curation import with_coordinates
    return with_coordinates(places(spark, sf)).select("seq", F.round("geo_lat", 6).alias("lat"), F.round("geo_lng", 6).alias("lng"), "geo_source")


@query("geo_forms", "F24 J20 P20", with_places("""
SELECT seq, round(sqrt((geo_lat - 13.7563) * (geo_lat - 13.7563) + (geo_lng - 100.5018) * (geo_lng - 100.5018)), 6) AS distance,
  coalesce(geo_lat BETWEEN 13.5 AND 14.0 AND geo_lng BETWEEN 100.3 AND 100.8, false) AS in_city FROM places WHERE geo_lat IS NOT NULL"""))
def _(spark, sf):
    return places(spark, sf).where("geo_lat is not null").select("seq", F.round(G.distance_from_center("geo_lat", "geo_lng"), 6).alias("distance"), G.in_city_box("geo_lat", "geo_lng").alias("in_city"))


# ---- dates ------------------------------------------------------------------------------------------

@query("local_day", "D1 D8 P6", """
SELECT strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS day, count(*) AS n, min(strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')) AS first_start,
 max(strftime(date_trunc('day', ts) + INTERVAL '86399' SECOND, '%Y-%m-%d %H:%M:%S')) AS last_end FROM events GROUP BY 1""")
def _(spark, sf):
    b = D.day_bounds("ts")
    f = "yyyy-MM-dd HH:mm:ss"
    return table(spark, sf, "events").groupBy(D.local_day("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.date_format(b["start"], f)).alias("first_start"), F.max(F.date_format(b["end"], f)).alias("last_end"))


_FORMS = {"dmy": "%-d %b %Y", "mdy": "%b %-d, %Y", "iso": "%Y-%m-%d", "dm": "%-d %b", "md": "%b %-d"}
_FORM_SPARK = {"dmy": "d MMM yyyy", "mdy": "MMM d, yyyy", "iso": "yyyy-MM-dd", "dm": "d MMM", "md": "MMM d"}


@query("dates_parsed", "D2 D7", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_dmy, strftime(o_orderdate, '%Y-%m-%d') AS day_mdy, strftime(o_orderdate, '%Y-%m-%d') AS day_iso,
 CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE '2025-' || strftime(o_orderdate, '%m-%d') END AS day_dm,
 CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL ELSE '2025-' || strftime(o_orderdate, '%m-%d') END AS day_md FROM orders""")
def _(spark, sf):
    as_of = F.lit("2025-06-15").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", *[
        D.parse_absolute(F.concat(F.lit("On "), F.date_format("o_orderdate", f), F.lit(" at eight")), as_of).cast("string").alias(f"day_{n}") for n, f in _FORM_SPARK.items()])


@query("day_ranges_parsed", "D3 D4 D5 D6", """
WITH t AS (SELECT o_orderkey, cast(o_orderdate AS date) AS d, cast(o_orderkey % 5 AS int) AS k FROM orders), u AS (
SELECT o_orderkey, k, d, make_date(2025, month(d), least(day(d), 27)) AS s, cast(last_day(d) AS date) AS ml FROM t)
SELECT o_orderkey, cast(CASE k WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN d WHEN 3 THEN d + ((5 - dayofweek(d) + 7) % 7)::int ELSE d END AS varchar) AS range_start,
 cast(CASE k WHEN 0 THEN s + 1 WHEN 1 THEN s + 1 WHEN 2 THEN ml WHEN 3 THEN d + ((5 - dayofweek(d) + 7) % 7)::int ELSE d + 40 END AS varchar) AS range_end FROM u""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 5).cast("int").alias("k"))
    first = F.least(F.dayofmonth("d"), F.lit(27)).cast("string")
    second = (F.least(F.dayofmonth("d"), F.lit(27)) + 1).cast("string")
    month = F.date_format("d", "MMM")
    text = (F.when(F.col("k") == 0, F.concat(first, F.lit("–"), second, F.lit(" "), month)).when(F.col("k") == 1, F.concat(month, F.lit(" "), first, F.lit("-"), second))
            .when(F.col("k") == 2, F.lit("until the end of month")).when(F.col("k") == 3, F.lit("Every Friday")))
    as_of = F.when(F.col("k") < 2, F.lit("2025-06-15").cast("date")).otherwise(F.col("d"))
    short = D.fill_start_end(F.lit(None).cast("date"), F.lit(None).cast("date"), text, as_of)
    wide = D.parse_dash_range(F.concat(F.date_format("d", "d MMM yyyy"), F.lit(" — "), F.date_format(F.date_add("d", 40), "d MMM yyyy")), as_of)
    return o.select("o_orderkey", F.when(F.col("k") == 4, wide["start"]).otherwise(short["start"]).cast("string").alias("range_start"),
                    F.when(F.col("k") == 4, wide["end"]).otherwise(short["end"]).cast("string").alias("range_end"))


@query("plan_windows", "D9 P9 P10 P11 P12", with_shows("""
SELECT count(*) AS n, sum(cast(day BETWEEN date '2024-01-10' AND date '2024-01-17' AS int)) AS next_week,
 sum(cast(greatest(day, date '2024-01-10') <= least(coalesce(until, day), date '2024-01-17') AS int)) AS overlapping,
 sum(cast(day BETWEEN date '2024-01-10' AND date '2024-01-24' AS int)) AS fresh, sum(cast(coalesce(date '2024-01-12' BETWEEN day AND until, false) AS int)) AS running,
 '2024-01-16' AS week_end FROM shows"""))
def _(spark, sf):
    as_of = F.lit("2024-01-10").cast("date")
    return shows(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(D.within_days("day", as_of)).alias("next_week"), F.count_if(D.range_within_days("day", "until", as_of)).alias("overlapping"),
                                F.count_if(D.within_days("day", as_of, 14)).alias("fresh"), F.count_if(D.day_in_range(F.lit("2024-01-12").cast("date"), "day", "until")).alias("running"),
                                F.first(D.plan_window("week", as_of)["end"].cast("string")).alias("week_end"))
