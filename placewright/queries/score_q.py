"""Flags, attributes, tags, quality and coolness."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import scoring as SC
from ..functions import tagging as TG
from ..operators import ranking as W
from ..operators import reports as R
from ..plans import curation as C
from ..sources.readers import table
from . import sqltext as S
from .inputs import curation_places, pick, places, shows, with_places, with_shows
from .registry import query

J = lambda c: F.concat_ws("|", c)

CONTENT = "lower(coalesce(name, '')) || ' ' || lower(coalesce(description, '')) || ' ' || array_to_string(tags, ' ')"


def _sum(parts):
    return "(" + " + ".join(parts) + ")"


def _filled(e):
    return f"coalesce(length(trim({e})) > 0, false)"


_HAS = {"name": _filled("name"), "city": _filled("city"), "domain": _filled("domain"), "url": _filled("url"), "description": _filled("description"), "address": _filled("address"),
        "geo_lat": "geo_lat IS NOT NULL", "geo_lng": "geo_lng IS NOT NULL", "tags": "len(tags) > 0", "flags": "len(flags) > 0", "phone": _filled("phone"), "email": _filled("email"),
        "website": _filled("website"), "hours": _filled("hours"), "price_level": "price_level IS NOT NULL", "rating": "rating IS NOT NULL"}
_COMPLETE = "round(least(" + _sum([f"CASE WHEN {_HAS[f]} THEN {w}e0 ELSE 0e0 END" for f, w in rules.FIELD_WEIGHTS.items()] + [f"CASE WHEN {_HAS[f]} THEN 2e-2 ELSE 0e0 END" for f in rules.OPTIONAL_FIELDS]) + ", 1e0), 3)"
_PHOTO = f"""CASE WHEN n_photos = 0 AND coalesce(image_url, '') = '' THEN 0e0 ELSE round(least(0.5e0 + CASE WHEN n_photos > 1 THEN 0.2e0 ELSE 0e0 END
  + CASE WHEN {S.has("lower(coalesce(image_url, ''))", rules.IMAGE_EXTENSIONS)} THEN 0.1e0 ELSE 0e0 END + CASE WHEN {S.has("lower(coalesce(image_url, ''))", rules.IMAGE_SIZE_WORDS)} THEN 0.1e0 ELSE 0e0 END
  + CASE WHEN n_photos >= 1 THEN 0.05e0 ELSE 0e0 END + CASE WHEN n_photos >= 2 THEN 0.05e0 ELSE 0e0 END, 1e0), 4) END"""
_FRESH = "CASE WHEN coalesce(last_updated, '') = '' THEN 0.5e0 " + " ".join(f"WHEN contains(last_updated, '{y}') THEN {s}e0" for y, s in rules.FRESHNESS_YEARS) + " ELSE 0.3e0 END"
_RELY = ("CASE WHEN coalesce(domain, '') = '' THEN 0.5e0 ELSE round(least(CASE replace(lower(domain), 'www.', '') " + " ".join(f"WHEN '{d}' THEN {s}e0" for d, s in rules.SOURCE_RELIABILITY.items())
         + " ELSE 0.5e0 END + CASE WHEN starts_with(url, 'https://') THEN 0.05e0 ELSE 0e0 END, 1e0), 4) END")
_VALID = ("round(" + _sum(["CASE WHEN length(trim(name)) > 0 THEN 0.2e0 ELSE 0e0 END", "CASE WHEN length(name) > 5 THEN 0.1e0 ELSE 0e0 END", "0.2e0", "CASE WHEN geo_lat IS NOT NULL THEN 0.2e0 ELSE 0e0 END",
                           "CASE WHEN length(trim(address)) > 10 THEN 0.1e0 ELSE 0e0 END", "0.1e0", "CASE WHEN length(trim(description)) > 20 THEN 0.1e0 ELSE 0e0 END"]) + ", 4)")
QUALITY_SQL = f"""scored AS (SELECT *, round(completeness * 0.4e0 + photo * 0.3e0 + freshness * 0.15e0 + reliability * 0.1e0 + validation * 0.05e0, 3) AS overall FROM (
  SELECT *, {_COMPLETE} AS completeness, {_PHOTO} AS photo, {_FRESH} AS freshness, {_RELY} AS reliability, {_VALID} AS validation FROM places)),
 rated AS (SELECT *, CASE WHEN overall >= 0.9 THEN 'excellent' WHEN overall >= 0.8 THEN 'good' WHEN overall >= 0.7 THEN 'acceptable' WHEN overall >= 0.6 THEN 'poor' ELSE 'unacceptable' END AS level,
  completeness >= 0.7 AND photo > 0 AND overall >= 0.6 AS accepted FROM scored)"""


def with_quality(body):
    return with_places(", " + QUALITY_SQL + " " + body.strip())


@query("flag_quality_topn", "F40 F50 F51 F52 F53 F54 F55 P16 P17 W3", with_quality(f"""
SELECT flag, rank, seq, overall FROM (SELECT flag, seq, overall, row_number() OVER (PARTITION BY flag ORDER BY overall DESC, seq) AS rank FROM (
 SELECT seq, overall, unnest({S.keyword_flags(CONTENT)}) AS flag FROM rated WHERE accepted)) WHERE rank <= 5"""))
def _(spark, sf):
    df = C.with_quality(curation_places(spark, sf)).where("accepted")
    flagged = df.select("seq", "overall", F.explode(TG.keyword_flags("name", "description", "tags")).alias("flag"))
    return W.top_n(flagged, ["flag"], [F.desc("overall"), F.asc("seq")], 5).select("flag", "rank", "seq", "overall")


@query("quality_scores", "F50 F51 F52 F53 F54 F55 F56", with_quality("""
SELECT seq, completeness, photo, freshness, reliability, validation, overall, level, accepted,
 CASE WHEN completeness < 0.7 THEN 1 ELSE 0 END + CASE WHEN photo = 0 THEN 1 ELSE 0 END + CASE WHEN overall < 0.6 THEN 1 ELSE 0 END AS n_warnings,
 CASE WHEN completeness < 0.8 THEN 1 ELSE 0 END + CASE WHEN photo < 0.5 THEN 1 ELSE 0 END + CASE WHEN freshness < 0.7 THEN 1 ELSE 0 END AS n_recommendations FROM rated"""))
def _(spark, sf):
    return C.with_quality(curation_places(spark, sf)).select("seq", "completeness", "photo", "freshness", "reliability", "validation", "overall", "level", "accepted",
                                                             F.size("warnings").alias("n_warnings"), F.size("recommendations").alias("n_recommendations"))


@query("quality_statistics", "A7", with_quality("""
SELECT count(*) AS total, sum(accepted::int) AS accepted, sum((NOT accepted)::int) AS rejected, round(avg(accepted::int), 4) AS acceptance_rate, round(avg(completeness), 4) AS avg_completeness,
 round(avg(photo), 4) AS avg_photo, round(avg(overall), 4) AS avg_overall FROM rated"""))
def _(spark, sf):
    return R.quality_run(C.with_quality(curation_places(spark, sf)), "accepted", ["completeness", "photo", "overall"])


@query("quality_levels", "A8", with_quality("SELECT level, count(*) AS n FROM rated GROUP BY 1"))
def _(spark, sf):
    return R.level_distribution(C.with_quality(curation_places(spark, sf)), "level")


@query("recipe_scores", "F57", with_places("""
SELECT seq, round((10 + CASE WHEN description IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN coalesce(image_url, '') <> '' THEN 20 ELSE 0 END + 15 + 10 + 15) / 1e2, 6) AS score FROM places"""))
def _(spark, sf):
    df = places(spark, sf)
    return df.select("seq", F.round(SC.recipe_score(df.schema), 6).alias("score"))


@query("flags_by_keyword", "F40", f"SELECT doc_id, array_to_string({S.keyword_flags('lower(text)')}, '|') AS flags FROM (SELECT doc_id, " + pick("Jazz gig|art class|street food|nothing|park walk, open bar", "doc_id") + " || ' ' || text AS text FROM documents)")
def _(spark, sf):
    text = F.concat(F.expr(pick("Jazz gig|art class|street food|nothing|park walk, open bar", "doc_id")), F.lit(" "), "text")
    none = F.array().cast("array<string>")
    return table(spark, sf, "documents").select("doc_id", J(TG.keyword_flags(text, F.lit(""), none)).alias("flags"))


_CASCADE_ARGS = "coalesce(title, '') || ' ' || coalesce(description, '')"


@query("flags_by_cascade", "F41", with_shows(f"""
SELECT seq, {S.cascade('title', rules.FLAG_CASCADE_TEXT, "'attractions'")} AS by_text, {S.cascade("concat_ws(' ', title, description)", rules.FLAG_CASCADE_CONTENT, "'attractions'")} AS by_content,
 {S.cascade('url', rules.FLAG_CASCADE_URL, "CASE WHEN category_text IN ('food', 'restaurants') THEN 'food_dining|restaurants' ELSE 'attractions' END")} AS by_url,
 array_to_string(list_filter([{', '.join(f"CASE WHEN {S.has('''lower(title || ' ' || array_to_string(tags, ' '))''', w)} THEN {S.q(f)} END" for f, w in sorted(rules.FLAGS_FROM_SUBSTRINGS.items()))}], lambda x: x IS NOT NULL), '|') AS by_substring FROM shows"""))
def _(spark, sf):
    return shows(spark, sf).select("seq", J(TG.cascade_flags("title")).alias("by_text"), J(TG.cascade_flags_content("title", "description")).alias("by_content"),
                                   J(TG.cascade_flags_url("url", "category_text")).alias("by_url"), J(TG.substring_flags("title", "tags")).alias("by_substring"))


@query("attributes_from_text", "F42", with_shows("SELECT seq, " + ", ".join(f"{e} AS {n}" for n, e in S.attrs("lower(title || ' ' || coalesce(description, ''))").items()) + " FROM shows"))
def _(spark, sf):
    a = TG.text_attributes("title", "description")
    return shows(spark, sf).select("seq", a.alias("a")).select("seq", *[F.col("a")[n].alias(n) for n in rules.ATTRIBUTE_WORDS])


_LABELS = "Featured,x|editor pick,Top Pick|must see|"


@query("tags_enriched", "F43", with_places(f"""
SELECT seq, array_to_string(list_filter(all_tags, lambda t, i: list_position(all_tags, t) = i), '|') AS tags FROM (
 SELECT seq, list_concat(list_transform(tags, lambda t: lower(trim(t))), CASE cast(ent % 4 AS int) WHEN 0 THEN ['featured'] WHEN 1 THEN ['editors_pick', 'top_pick'] WHEN 2 THEN ['must_see'] ELSE [] END) AS all_tags FROM places)"""))
def _(spark, sf):
    return places(spark, sf).select("seq", J(TG.enriched_tags("tags", F.split(F.expr(pick(_LABELS, "ent")), ","))).alias("tags"))


@query("tag_match_scores", "F44 U3", with_places("""
SELECT seq, CASE WHEN list_has_any(low, ['live music', 'music', 'concert', 'gig']) THEN 2 ELSE CASE WHEN list_has_any(tok, ['music', 'live', 'concert', 'gig']) THEN 1 ELSE 0 END END AS music,
 CASE WHEN list_has_any(low, ['art', 'exhibition', 'gallery']) THEN 2 ELSE CASE WHEN list_has_any(tok, ['art', 'exhibition', 'gallery']) THEN 1 ELSE 0 END END AS art,
 CASE WHEN list_has_any(low, ['market', 'markets', 'bazaar', 'fair', 'flea']) THEN 2 ELSE 0 END AS markets
FROM (SELECT seq, low, string_split(array_to_string(low, ' '), ' ') AS tok FROM (SELECT seq, list_transform(tags, lambda t: lower(t)) AS low FROM places))"""))
def _(spark, sf):
    return places(spark, sf).select("seq", *[TG.tag_match_score(F.lit(q), "tags").alias(q) for q in ("music", "art", "markets")])


@query("tag_combinations", "F47 U4", with_places("""
SELECT seq, round(CASE WHEN ent % 3 = 0 THEN 1.5e0 ELSE 1e0 END * CASE WHEN ent % 2 = 0 THEN 1.1e0 ELSE 1e0 END, 4) AS score FROM places"""))
def _(spark, sf):
    tags = F.concat(F.when(F.col("ent") % 3 == 0, F.array(F.lit("food_dining"), F.lit("nightlife"))).otherwise(F.array(F.lit("food_dining"), F.lit("shopping"))),
                    F.when(F.col("ent") % 2 == 0, F.array(F.lit("transportation"), F.lit("business_services"))).otherwise(F.array(F.lit("transportation"))))
    return places(spark, sf).select("seq", F.round(TG.combination_score(tags), 4).alias("score"))


@query("flags_from_tags", "A22", with_shows("""
SELECT seq, array_to_string(list_filter([CASE WHEN list_has_any(low, ['art', 'art & culture', 'exhibition']) THEN 'art' END, CASE WHEN list_has_any(low, ['culture', 'cultural']) THEN 'culture' END,
 CASE WHEN list_has_any(low, ['indoor']) THEN 'indoor' END, CASE WHEN list_has_any(low, ['live music', 'music', 'concert']) THEN 'live_music' END], lambda x: x IS NOT NULL), '|') AS flags
FROM (SELECT seq, list_transform(tags, lambda t: lower(t)) AS low FROM shows)"""))
def _(spark, sf):
    return shows(spark, sf).select("seq", J(TG.flags_from_tags("tags", F.create_map().cast("map<string,boolean>"))).alias("flags"))


_COOL = f"""round(0.25e0 * {S.first_value('site', rules.SOURCE_WEIGHTS, 0.4, 0.3)} + 0.35e0 * coalesce(ln(1 + least(greatest(popularity, 0), 500)) / ln(501e0), 0)
 + 0.10e0 * CASE WHEN price_min IS NULL THEN 0.5e0 WHEN price_min = 0 THEN 1e0 ELSE 1 - least(greatest(price_min, 0), 1200) / 1200 END
 + 0.08e0 * CASE WHEN {S.has('lower(time_str)', rules.NIGHT_TIMES)} OR {S.has('lower(category_text)', rules.NIGHT_CATEGORIES)} THEN 0.7e0 ELSE 0.5e0 END
 + 0.12e0 * {S.first_value('venue', rules.VENUE_RANKS, 0.5, 0.4)} + 0.08e0 * CASE WHEN {S.has("lower(concat_ws(' ', title, description))", rules.TEXT_BONUS)} THEN 1e0 ELSE 0.5e0 END
 + 0.02e0 * CASE WHEN day = date '2024-01-10' THEN 1e0 ELSE 0.5e0 END, 8)"""
_BOOST = f"""round(cool + CASE WHEN {S.has("lower(title || coalesce(description, ''))", rules.BOOST_TEXT)} THEN 0.3e0 ELSE 0e0 END + CASE WHEN {S.has("lower(coalesce(venue, ''))", rules.BOOST_VENUES)} THEN 0.2e0 ELSE 0e0 END
 + CASE WHEN contains(lower(tag_text), 'picks') THEN 0.5e0 ELSE 0e0 END + CASE WHEN contains(lower(tag_text), 'hot') THEN 0.3e0 ELSE 0e0 END, 8)"""


def scored_shows(spark, sf):
    df = shows(spark, sf)
    df = df.withColumn("cool", SC.coolness("site", "popularity", "price_min", "time_str", "category_text", "venue", "title", "description", "day", F.lit("2024-01-10").cast("date"), 8))
    return df.withColumn("boosted", SC.boosted("cool", "title", "description", "venue", "tags", 8))


COOL_SQL = f", cooled AS (SELECT *, {_COOL} AS cool FROM shows), scored AS (SELECT *, {_BOOST} AS boosted FROM cooled) "


@query("coolness_scores", "F58 F59 J8", with_shows(COOL_SQL + "SELECT seq, cool, round(boosted - cool, 3) AS boost FROM scored"))
def _(spark, sf):
    return scored_shows(spark, sf).select("seq", "cool", F.round(F.col("boosted") - F.col("cool"), 3).alias("boost"))


@query("simple_coolness", "F60", with_places("""
SELECT seq, round(s, 6) AS score, round(s * (1 + CASE WHEN popularity > 7 THEN 0.2e0 ELSE 0e0 END + CASE WHEN rating > 4.5 THEN 0.1e0 ELSE 0e0 END), 6) AS boosted
FROM (SELECT *, popularity * 0.5e0 + rating * 0.3e0 + CASE WHEN coalesce(image_url, '') <> '' THEN 0.2e0 ELSE 0e0 END + 0.1e0 AS s FROM places)"""))
def _(spark, sf):
    args = ("popularity", "rating", "image_url", "area")
    return places(spark, sf).select("seq", F.round(SC.simple_coolness(*args), 6).alias("score"), F.round(SC.simple_boost(*args), 6).alias("boosted"))


_TOPIC = "jazz bars tonight|where to find street food|museum or parks|plain text"


@query("query_to_flags", "F62", "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten([" + ", ".join(
    f"CASE WHEN {S.has('t', [k, *v])} THEN {S.strs(v)} ELSE [] END" for k, v in rules.QUERY_FLAGS.items()) + "]))), '|') AS flags FROM (SELECT conv_id, turn, lower(trim(" + pick(_TOPIC, "conv_id + turn") + " || ' ' || text)) AS t FROM conversations)")
def _(spark, sf):
    text = F.concat(F.expr(pick(_TOPIC, "conv_id + turn")), F.lit(" "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", J(TG.flags_for_query(text)).alias("flags"))
