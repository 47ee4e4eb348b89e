"""Place, show and page records derived from the given tables.

Every expression is plain enough to mean the same in Spark SQL and in DuckDB, so a query and its SQL twin
start from the same rows. Row counts follow the given tables: one place per customer, one show per event,
one web page per page.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.readers import table


def pick(options: str, index: str, sep: str = "|") -> str:
    """SQL: the option at a zero-based index expression, taken modulo the number of options."""
    n = len(options.split(sep))
    return f"split_part('{options}', '{sep}', cast(({index}) % {n} as int) + 1)"


def names(stages: list[dict[str, str]]) -> list[str]:
    return list(stages[-1])


def to_sql(source: str, stages: list[dict[str, str]]) -> str:
    text = source
    for stage in stages:
        cols = ", ".join(f"{e} AS {n}" for n, e in stage.items())
        text = f"(SELECT {cols} FROM {text} s)"
    return text


def build(df: DataFrame, stages: list[dict[str, str]]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr(*[f"{e} AS {n}" for n, e in stage.items()])
    return df


def keep(*cols: str) -> dict[str, str]:
    return {c: c for c in cols}


# ---- places: one per customer; three customers describe one entity -------------------------------------

LETTERS = "'0123456789abcdef', 'aeioubdfgklmnprs'"
TEXTS = ("Live jazz band and blues every friday night|Street food market by the river, cheap and local|Contemporary art gallery &amp; museum tour"
         "|Rooftop skybar with a great view, luxury cocktails|Yoga and meditation retreat in a quiet garden|Workshop and craft class, learning for all"
         "|Indie film screening and cinema opening|Shopping mall  and  bazaar,   moderate prices|Authentic thai food in an amazing place, fine dining"
         "|Walk in the park, nature and outdoor fun|Electronic club with dj and late night party|<b>Hidden</b> temple street, traditional heritage festival")
TAGS = "food,Restaurant,street food|Jazz,live music,bar|art,gallery,Art,exhibition|market,shopping,mall|yoga,wellness,spa|park,nature,outdoor|cinema,movie,night|rooftop,view,Bar"
FLAGS = "food_dining,cafes|jazz_blues,nightlife|art_exhibits,culture|markets,shopping|yoga_wellness,wellness|parks,nature|cinema,entertainment|rooftop,bars"
AREAS = "Sukhumvit Road|silom|Siam  Square|thonglor|Near Chatuchak|yaowarat area|ARI|asoke st|Nowhere Town|soi 11 sukhumvit"

PLACES: list[dict[str, str]] = [
    {"seq": "c_custkey", "ent": "cast(floor(c_custkey / 3) as bigint)", "copy": "cast(c_custkey % 3 as int)",
     "h": "md5(cast(cast(floor(c_custkey / 3) as bigint) as string))", "bal": "c_acctbal"},
    {**keep("seq", "ent", "copy", "h", "bal"),
     "stem": f"concat(translate(substr(h, 1, 6), {LETTERS}), ' ', translate(substr(h, 7, 7), {LETTERS}))",
     "kind": pick("restaurant|cafe|bar|gallery|museum|market|park|spa|cinema|temple", "ent"),
     "area": pick(AREAS, "ent")},
    {"seq": "seq", "ent": "ent", "copy": "copy", "id": "concat('pl-', cast(seq as string))",
     "name": "case copy when 0 then concat(stem, ' ', kind) when 1 then concat('The ', stem, ' ', kind) else concat(stem, 's ', kind) end",
     "city": pick("bangkok|bangkok|bangkok|phuket|chiang mai", "ent"),
     "area": "area",
     "address": "case when ent % 11 = 0 then null else concat(cast(ent % 997 + 1 as string), ' ', area, ' Road, Soi ', cast(ent as string), ', Bangkok') end",
     "domain": pick("timeout.com|www.bk-magazine.com|coconuts.co|example.org|", "ent"),
     "url": "concat(case when ent % 4 = 0 then 'http://' else 'https://' end, 'www.example.com/', kind, '/', cast(ent as string))",
     "description": f"case when ent % 13 = 0 then null else concat({pick(TEXTS, 'ent')}, case when copy = 2 then ' (updated)' else '' end) end",
     "geo_lat": "case when ent % 17 = 0 then null else 1.35e1 + cast(((ent * 7919) % 100003) as double) / 2e5 + copy * 2e-4 end",
     "geo_lng": "case when ent % 17 = 0 then null else 1.003e2 + cast(((ent * 104729) % 100019) as double) / 2e5 + copy * 3e-4 end",
     "tags": f"split({pick(TAGS, 'ent')}, ',')", "flags": f"split({pick(FLAGS, 'ent')}, ',')",
     "image_url": "case when ent % 5 = 0 then null when ent % 5 = 1 then '' else concat('https://img.example.com/large/', cast(ent as string), '.jpg') end",
     "n_photos": "cast(ent % 4 as int)",
     "phone": "case when ent % 3 = 0 then '+66 2 123 4567' else null end", "email": "cast(null as string)",
     "website": "case when ent % 2 = 0 then 'https://example.com' else '' end", "hours": "case when ent % 7 = 0 then 'Open 10:00 AM - 9:00 PM' else null end",
     "price_level": "cast(ent % 5 as int)", "rating": "cast((ent * 37) % 50 as double) / 1e1",
     "last_updated": f"case when ent % 6 = 5 then null else {pick('2025-03-01|2024-11-30|2023-05-05|2022-01-01|2019-07-07', 'ent')} end",
     "source": pick("guide_a|guide_b|guide_c|guide_a", "ent"),
     "source_url": "concat('https://src.example.com/', cast(ent % 5000 as string))",
     "popularity": "cast((ent * 13) % 700 as int)", "quality_score": "cast((ent * 91) % 1000 as double) / 1e3",
     "updated_at": "date_add(date '2024-01-01', cast((ent * 17) % 365 as int))", "bal": "bal"},
]

# ---- shows: one per event; three events describe one show ------------------------------------------------

TITLES = "Jazz night at the rooftop|Food market opening|Art exhibition &amp; vernissage|Electronic festival|Yoga in the park|Indie film premiere|Craft workshop for kids|Street art awards"
VENUES = "BACC|River City Bangkok|Lumpini Park|MOCA|Beam Club||House of Film"
SHOW_TAGS = "Jazz,live music,Picks|food,market|art,exhibition,hot|electronic,dj|yoga,outdoor|cinema,film|workshop,kids|culture,art"
CATS = "jazz_blues,Bars|food|art_exhibits,Culture|electronic|yoga_wellness|cinema|workshops|art_exhibits"

SHOWS: list[dict[str, str]] = [
    {"seq": "event_id", "ent": "cast(floor(event_id / 3) as bigint)", "copy": "cast(event_id % 3 as int)", "ts": "ts", "user_id": "user_id",
     "event_type": "event_type", "value": "value", "props": "props",
     "h": "md5(cast(cast(floor(event_id / 3) as bigint) as string))"},
    {"seq": "seq", "ent": "ent", "copy": "copy", "id": "concat('ev-', cast(seq as string))",
     "title": f"concat({pick(TITLES, 'ent')}, ' ', translate(substr(h, 1, 7), {LETTERS}), case when copy = 2 then 's' else '' end)",
     "day": "date_add(date '2024-01-01', cast(ent % 30 as int))",
     "until": "case when ent % 4 = 0 then date_add(date '2024-01-01', cast(ent % 30 + ent % 3 as int)) else null end",
     "start": "cast(date_add(date '2024-01-01', cast(ent % 30 as int)) as timestamp)",
     "venue": f"nullif({pick(VENUES, 'ent')}, '')",
     "description": f"case when copy = 1 then null else concat('About ', {pick(TITLES, 'ent')}, case when copy = 2 then ', now longer' else '' end) end",
     "image": "case when copy = 0 then 'data:image/svg+xml;base64,AAAA' when ent % 3 = 0 then null else concat('https://img.example.com/', cast(seq as string), '.png') end",
     "url": "case when ent % 23 = 7 then '' else concat('https://shows.example.com/', cast(seq as string)) end",
     "tags": f"split({pick(SHOW_TAGS, 'ent')}, ',')", "categories": f"split({pick(CATS, 'ent')}, ',')",
     "tag_text": pick(SHOW_TAGS, "ent"), "category_text": pick(CATS, "ent"),
     "source": pick("other_site|bk_magazine|timeout_bkk", "copy"),
     "site": pick("ra.co|timeout.com|eventbrite.com|unknown.net|", "ent"),
     "fetched_at": "ts", "price_min": "case when ent % 5 = 0 then null when ent % 5 = 1 then 0e0 else value end",
     "popularity": "case when ent % 7 = 0 then null else cast((ent * 29) % 900 as int) end",
     "time_str": pick("20:30|10:00 AM|late|", "ent"),
     "city": pick("bangkok|bangkok|phuket", "ent"), "user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props", "ts": "ts"},
]

# ---- web pages: the given page with head tags, a JSON-LD block and a list added ----------------------------

PID = "cast(page_id as string)"
LD = ("case cast(page_id % 5 as int)"
      " when 0 then concat('{\"@type\":\"Restaurant\",\"name\":\"Cafe ', " + PID + ", '\",\"description\":\"Good food\",\"image\":[\"https://img.example.com/', " + PID + ", '.jpg\"],\"geo\":{\"latitude\":13.75,\"longitude\":100.5}}')"
      " when 1 then concat('{\"@graph\":[{\"@type\":\"MusicEvent\",\"name\":\"Gig ', " + PID + ", '\",\"startDate\":\"2024-01-05\",\"location\":{\"name\":\"Hall ', cast(page_id % 9 as string), '\"},\"offers\":{\"price\":\"', cast(page_id % 50 * 10 as string), '\"}},{\"@type\":\"Place\",\"name\":\"Hall\"}]}')"
      " when 2 then concat('[{\"@type\":[\"Event\",\"Thing\"],\"name\":\"Fair ', " + PID + ", '\",\"startDate\":\"2024-02-01\",\"location\":\"Main Square\"},{\"@type\":\"Hotel\",\"name\":\"Inn ', " + PID + ", '\"}]')"
      " when 3 then '{broken json' else '' end")
PAGE_PATHS = "/bangkok/restaurants|/gallery/photos|/search?q=jazz|/bangkok/bar/one|/category/food|/fr/about"

WEB: list[dict[str, str]] = [
    {"page_id": "page_id", "url": "url", "ld": LD, "html": "html"},
    {"page_id": "page_id",
     "url": f"concat('https://', case when page_id % 2 = 0 then 'www.timeout.com' else 'www.example.com' end, {pick(PAGE_PATHS, 'page_id')}, case when page_id % 6 = 2 then '&p=' else '/' end, {PID})",
     "html": ("concat(replace(html, '</head>', concat('<meta property=\"og:title\" content=\"Place ', " + PID + ", ' &amp; Co\"><meta content=\"About place ', " + PID + ", '\" property=\"og:description\">',"
              " case when page_id % 3 = 0 then concat('<meta property=\"og:image\" content=\"/img/', " + PID + ", '.png\">') else '' end,"
              " case when page_id % 7 = 3 then '<meta name=\"geo.position\" content=\"13.71;100.52\">' else '' end,"
              " case when ld <> '' then concat('<script type=\"application/ld+json\">', ld, '</script>') else '' end, '</head>')),"
              " '<div class=\"card\" data-id=\"', " + PID + ", '\"><h3 class=\"title\">Blue ', case when page_id % 2 = 0 then 'Lotus Restaurant' else 'Door Gallery' end, '</h3><img src=\"/c/', " + PID + ", '.jpg\"><span class=\"price\">', cast(page_id % 40 * 25 as string), ' THB</span></div>',"
              " '<p>Rated 4.', cast(page_id % 10 as string), ' stars, ', cast(page_id % 3 + 1 as string), ',', lpad(cast(page_id % 1000 as string), 3, '0'), ' reviews. Open 10:00 AM - 9:30 PM. Call +66 2 123 4567. Free wifi and parking. ', cast(page_id % 300 as string), ' interested</p>')")},
]


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Dealt out by key: a row is a few bytes in its file and much work afterwards, so the given files alone would make too few tasks.

    The two columns are written and read again, as filters on what is derived would pass below a mere repartition.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return build(written(table(spark, sf, "customer").select("c_custkey", "c_acctbal").repartition(parts, "c_custkey")), PLACES)


def shows(spark: SparkSession, sf: str) -> DataFrame:
    return build(table(spark, sf, "events"), SHOWS)


def web(spark: SparkSession, sf: str) -> DataFrame:
    return build(table(spark, sf, "pages"), WEB)


def curation_places(spark: SparkSession, sf: str) -> DataFrame:
    """Places with a photo list made from the photo count."""
    return places(spark, sf).withColumn("photos", F.expr(
        "transform(slice(array(1, 2, 3), 1, n_photos), i -> named_struct('url', concat('https://img.example.com/', i), "
        "'width', case when i = 2 then 800 end, 'height', case when i = 2 then 600 end, 'alt_text', case when i = 1 then name end))"))


PLACES_SQL = to_sql("customer", PLACES)
SHOWS_SQL = to_sql("events", SHOWS)
WEB_SQL = to_sql("pages", WEB)


def with_places(body: str) -> str:
    return f"WITH places AS {PLACES_SQL} {body.strip()}"


def with_shows(body: str) -> str:
    return f"WITH shows AS {SHOWS_SQL} {body.strip()}"


def with_web(body: str) -> str:
    return f"WITH web AS {WEB_SQL} {body.strip()}"
