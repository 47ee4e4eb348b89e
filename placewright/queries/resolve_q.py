"""Duplicates: keys, fuzzy pairs, addresses, nearest points, components, merges."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import tagging as TG
from ..functions import text as X
from ..operators import extract as E
from ..operators import graph, merge, reports
from ..operators import resolve as R
from ..operators import similarity as SIM
from ..plans import curation as C
from ..plans import ingest as PI
from ..sources.readers import table
from . import sqltext as S
from .inputs import curation_places, places, shows, with_places, with_shows
from .registry import query
from .score_q import QUALITY_SQL

J = lambda c: F.concat_ws("|", c)

KEYED = f"k AS (SELECT *, {S.match_key()} AS match_key, {S.match_name('name')} AS mn, {S.match_address('address')} AS ma FROM places)"


@query("identity_groups", "J10 A6", with_places(f", {KEYED} SELECT k.match_key AS group_key, first_id, seq AS id, group_size FROM k JOIN (SELECT match_key, min(seq) AS first_id, count(*) AS group_size FROM k GROUP BY 1 HAVING count(*) > 1) g USING (match_key)"))
def _(spark, sf):
    return R.duplicate_groups(R.with_match_columns(places(spark, sf)), "match_key", "seq")


_FUZZY = f"""pairs AS (SELECT a.seq AS id_a, b.seq AS id_b, {S.lev_ratio('a.mn', 'b.mn')} AS score FROM k a JOIN k b ON a.city = b.city AND a.seq < b.seq AND abs(length(a.mn) - length(b.mn)) <= 0.14 * greatest(length(a.mn), length(b.mn))
 WHERE {S.lev_ratio('a.mn', 'b.mn')} >= 0.86)"""


@query("fuzzy_name_pairs", "J12 F22", with_places(f", {KEYED}, {_FUZZY}, firsts AS (SELECT city, mn, min(seq) AS f FROM k GROUP BY 1, 2) SELECT id_a, id_b, round(score, 6) AS score FROM pairs WHERE score < 1 AND id_a IN (SELECT f FROM firsts) AND id_b IN (SELECT f FROM firsts)"
       " UNION ALL SELECT f, seq, 1 FROM k JOIN firsts USING (city, mn) WHERE seq > f"))
def _(spark, sf):
    base = R.with_match_columns(places(spark, sf))
    return SIM.similar_texts(base, "seq", "match_name", rules.FUZZY_NAME_RATIO, ["city"]).select("id_a", "id_b", F.round("score", 6).alias("score"))


@query("gestalt_name_pairs", "F22 UD3")
def _(spark, sf):
    base = R.with_match_columns(places(spark, sf))
    return SIM.similar_texts(base, "seq", "match_name", rules.FUZZY_NAME_RATIO, ["city"], metric="gestalt").select("id_a", "id_b", F.round("score", 6).alias("score"))


@query("document_near_copies", "J12 F23", """WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS ws FROM documents),
 n AS (SELECT lang, ws, min(doc_id) AS id FROM w JOIN documents USING (doc_id) GROUP BY 1, 2),
 near AS (SELECT a.id AS id_a, b.id AS id_b FROM n a JOIN n b ON a.lang = b.lang AND a.id < b.id AND least(len(a.ws), len(b.ws)) >= 0.8 * greatest(len(a.ws), len(b.ws)) WHERE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) > 0.8)
 SELECT id_a, id_b FROM near UNION SELECT n.id, d.doc_id FROM n JOIN documents d ON d.lang = n.lang JOIN w ON w.doc_id = d.doc_id AND w.ws = n.ws WHERE d.doc_id <> n.id""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("w"))
    return SIM.similar_sets(docs, "doc_id", "w", 0.8, ["lang"]).select("id_a", "id_b")


@query("address_matches", "J13", with_places(f", {KEYED} SELECT k.seq AS seq, g.match FROM k JOIN (SELECT ma, min(seq) AS match FROM k WHERE ma <> '' GROUP BY 1) g ON k.ma = g.ma WHERE k.seq > g.match"))
def _(spark, sf):
    base = R.with_match_columns(places(spark, sf)).where("match_address <> ''")
    return R.earliest_with_key(base, "address_hash")


_NEAR = "near AS (SELECT b.seq AS seq, a.seq AS match, sqrt((a.geo_lat - b.geo_lat) * (a.geo_lat - b.geo_lat) + (a.geo_lng - b.geo_lng) * (a.geo_lng - b.geo_lng)) AS d FROM places a JOIN places b ON a.seq < b.seq AND abs(a.geo_lat - b.geo_lat) <= 0.0011 AND abs(a.geo_lng - b.geo_lng) <= 0.0011)"


@query("nearest_places", "J14 F24", with_places(f", {_NEAR} SELECT seq, match, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY d, match) AS r FROM near WHERE d <= 0.001) WHERE r = 1"))
def _(spark, sf):
    return R.nearest_within(places(spark, sf), "geo_lat", "geo_lng", rules.GEO_TOLERANCE).select("seq", "match", F.round("distance", 6).alias("distance"))


@query("nearest_vectors", "J14", """WITH e AS (SELECT vec_id, round(embedding[1]::double, 6) AS x, round(embedding[2]::double, 6) AS y FROM embeddings), n AS (SELECT b.vec_id AS seq, a.vec_id AS match, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM e a JOIN e b ON a.vec_id < b.vec_id)
 SELECT seq, match FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY d, match) AS r FROM n WHERE d <= 0.02) WHERE r = 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"), F.round(F.col("embedding")[1].cast("double"), 6).alias("y"))
    return R.nearest_within(e, "x", "y", 0.02).select("seq", "match")


_MATCH = f"""{KEYED}, {_FUZZY}, {_NEAR}, m AS (
 SELECT k.seq, min(g.m) AS match, 0 AS s FROM k JOIN (SELECT match_key, min(seq) AS m FROM k GROUP BY 1) g USING (match_key) WHERE k.seq > g.m GROUP BY 1
 UNION ALL SELECT id_b, id_a, 1 FROM (SELECT *, row_number() OVER (PARTITION BY id_b ORDER BY score DESC, id_a) AS r FROM pairs) WHERE r = 1
 UNION ALL SELECT k.seq, g.m, 2 FROM k JOIN (SELECT ma, min(seq) AS m FROM k WHERE ma <> '' GROUP BY 1) g ON g.ma = k.ma WHERE k.seq > g.m
 UNION ALL SELECT seq, match, 3 FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY d, match) AS r FROM near WHERE d <= 0.001) WHERE r = 1),
 best AS (SELECT seq, arg_min(match, s) AS match, ['identity', 'fuzzy', 'address', 'geo'][min(s) + 1] AS strategy FROM m GROUP BY 1)"""
_ROOT = _MATCH + """, up(seq, root) AS (SELECT seq, match FROM best UNION ALL SELECT up.seq, best.match FROM up JOIN best ON best.seq = up.root), roots AS (SELECT seq, min(root) AS root FROM up GROUP BY 1)"""


def _rec(body):
    return with_places(body).replace("WITH places", "WITH RECURSIVE places", 1)


@query("matched_rows", "J10 J12 J13 J14 A9", with_places(f", {_MATCH} SELECT seq, match, strategy FROM best"))
def _(spark, sf):
    return R.match_rows(places(spark, sf))


@query("dedup_statistics", "A9 A28", with_places(f", {_MATCH} SELECT (SELECT count(*) FROM places) AS total, (SELECT count(*) FROM places) - count(*) AS unique_places, count(*) AS duplicates, sum((strategy = 'identity')::int) AS identity_matches, sum((strategy = 'fuzzy')::int) AS fuzzy_matches, "
       "sum((strategy = 'address')::int) AS address_matches, sum((strategy = 'geo')::int) AS geo_matches, round(count(*) / (SELECT count(*) FROM places), 4) AS duplicate_rate FROM best"))
def _(spark, sf):
    df = places(spark, sf)
    return R.dedup_statistics(R.resolve(df, R.match_rows(df))).drop("duplicate_groups")


@query("duplicate_components", "A28", _rec(f", {_ROOT} SELECT seq, root FROM roots"))
def _(spark, sf):
    df = places(spark, sf).select("seq", "name", "city", "domain", "address", "geo_lat", "geo_lng")
    return R.resolve(df, R.match_rows(df)).where("is_duplicate").select("seq", "root")


@query("curated_status", "PL1 A10", with_places(f", {QUALITY_SQL}, {_MATCH} SELECT CASE WHEN b.seq IS NOT NULL THEN 'duplicate' WHEN accepted THEN 'new' ELSE 'rejected' END AS status, coalesce(strategy, '') AS strategy, count(*) AS n FROM rated LEFT JOIN best b USING (seq) GROUP BY 1, 2"))
def _(spark, sf):
    return C.curate(curation_places(spark, sf)).groupBy("status", F.coalesce("strategy", F.lit("")).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query("curation_rates", "A10", with_places(f", {QUALITY_SQL}, {_MATCH}, st AS (SELECT CASE WHEN b.seq IS NOT NULL THEN 'duplicate' WHEN accepted THEN 'new' ELSE 'rejected' END AS status FROM rated LEFT JOIN best b USING (seq)) SELECT count(*) AS total, count(*) FILTER (status = 'new') AS new_places, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status = 'rejected') AS rejected, 0 AS errors, round(count(*) FILTER (status = 'new') / count(*), 4) AS success_rate, 0.0 AS error_rate FROM st"))
def _(spark, sf):
    return reports.status_statistics(C.curate(curation_places(spark, sf)))


# ---- event merge -------------------------------------------------------------------------------------

_GROUP = f"""t AS (SELECT *, lower({S.norm('title')}) AS nt, lower({S.norm('venue')}) AS nv FROM shows),
 e AS (SELECT a.seq AS a, b.seq AS b FROM t a JOIN t b ON a.day = b.day AND a.nv = b.nv AND a.seq < b.seq AND {S.lev_ratio('a.nt', 'b.nt')} >= 0.9
   UNION SELECT m, seq FROM (SELECT seq, min(seq) OVER (PARTITION BY nt, day, coalesce(nv, '')) AS m FROM t) WHERE m < seq),
 both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(id, seen) AS (SELECT a, b FROM both_ UNION SELECT r.id, x.b FROM reach r JOIN both_ x ON x.a = r.seen),
 g AS (SELECT t.*, coalesce(least(t.seq, m), t.seq) AS group_id FROM t LEFT JOIN (SELECT id, min(seen) AS m FROM reach GROUP BY 1) x ON x.id = t.seq)"""
_RANK = "CASE lower(source) WHEN 'timeout_bkk' THEN 0 WHEN 'bk_magazine' THEN 1 ELSE 3 END"


def _show_rec(body):
    return with_shows(body).replace("WITH shows", "WITH RECURSIVE shows", 1)


def merge_input(spark, sf):
    df = shows(spark, sf).withColumn("desc", F.col("description"))
    return df.withColumn("attrs", TG.text_attributes("title", "description")).select("seq", "id", "title", "desc", "start", "venue", "image", "url", "tags", "categories", "source", "fetched_at", "attrs")


@query("event_groups", "J11 A28 J10", _show_rec(f", {_GROUP} SELECT seq, group_id FROM g"))
def _(spark, sf):
    return PI.group_events(merge_input(spark, sf)).select("seq", "group_id")


@query("merged_events", "A23 A25 A26 A27 W1 UD4 PL2", _show_rec(f""", {_GROUP}, m AS (SELECT group_id, arg_min(id, {_RANK} * 1e16 - epoch_us(fetched_at)) AS id, arg_min(url, {_RANK} * 1e16 - epoch_us(fetched_at)) AS url, max(length({S.norm('description')})) AS desc_len,
  arg_min(image, seq) FILTER (coalesce(image, '') <> '' AND NOT starts_with(image, 'data:image/svg+xml')) AS image, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS fetched, count(*) AS merged_count,
  bool_or({S.has("lower(title || ' ' || coalesce(description, ''))", rules.ATTRIBUTE_WORDS['market'])}) AS market FROM g GROUP BY 1),
 s AS (SELECT group_id, string_agg(source, '|' ORDER BY f) AS sources FROM (SELECT group_id, source, min(seq) AS f FROM g GROUP BY 1, 2) GROUP BY 1), tg AS (SELECT group_id, string_agg(tag, '|' ORDER BY f) AS tags FROM (SELECT group_id, tag, min(f) AS f FROM (SELECT group_id, lower(trim(unnest(tags))) AS tag, seq * 1000 + generate_subscripts(tags, 1) AS f FROM g) GROUP BY 1, 2) GROUP BY 1)
 SELECT m.*, sources, tags FROM m JOIN s USING (group_id) JOIN tg USING (group_id)"""))
def _(spark, sf):
    merged, _ = PI.merge_run(merge_input(spark, sf))
    return merged.select("group_id", "id", "url", F.length("desc").alias("desc_len"), "image", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "merged_count",
                         F.coalesce(F.try_element_at("attrs", F.lit("market")), F.lit(False)).alias("market"), J("sources").alias("sources"), J("tags").alias("tags"))


@query("duplicate_percent", "A5 A6", with_shows(f"SELECT sum(n) AS total, sum((n > 1)::int) AS duplicate_groups, sum(n - 1) AS duplicate_events, round(sum(n - 1) * 100.0 / sum(n), 2) AS duplicates_pct FROM (SELECT count(*) AS n FROM (SELECT lower({S.norm('title')}) AS t, day, coalesce({S.norm('venue')}, '') AS v FROM shows) GROUP BY t, day, v)"))
def _(spark, sf):
    from ..operators.reports import duplicate_percent
    return duplicate_percent(PI.with_event_keys(shows(spark, sf)), "identity")


# ---- similar rows of one page, merged ------------------------------------------------------------------

def page_rows(spark, sf):
    """Three extraction rows per place, eight places per page."""
    p = places(spark, sf).where("seq >= 0")
    return p.select("seq", F.floor(F.col("seq") / 24).alias("page_id"), F.lower("name").alias("name"), F.when(F.col("copy") == 0, F.col("url")).otherwise(F.lit("")).alias("url"),
                    F.when(F.col("copy") == 0, "jsonld").when(F.col("copy") == 1, "opengraph").otherwise("css").alias("method"), "description", "image_url", "area", "tags", "flags",
                    F.when(F.col("copy") == 0, 0.95).when(F.col("copy") == 1, 0.85).otherwise(0.70).alias("confidence"))


_PAGE = """r AS (SELECT seq, cast(floor(seq / 24) AS bigint) AS page_id, lower(name) AS name, CASE WHEN copy = 0 THEN url ELSE '' END AS url, CASE copy WHEN 0 THEN 'jsonld' WHEN 1 THEN 'opengraph' ELSE 'css' END AS method, description, image_url, tags,
 CASE copy WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.70 END AS confidence, list_distinct(string_split(lower(name), ' ')) AS nw, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(description, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS dw FROM places),
 e AS (SELECT a.seq AS a, b.seq AS b FROM r a JOIN r b ON a.page_id = b.page_id AND a.seq < b.seq WHERE a.name = b.name OR len(list_intersect(a.nw, b.nw)) / len(list_distinct(list_concat(a.nw, b.nw))) > 0.8 OR (a.url <> '' AND a.url = b.url)
  OR (a.method = b.method AND len(a.dw) > 0 AND len(b.dw) > 0 AND len(list_intersect(a.dw, b.dw)) / len(list_distinct(list_concat(a.dw, b.dw))) > 0.7)),
 both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(id, seen) AS (SELECT a, b FROM both_ UNION SELECT q.id, x.b FROM reach q JOIN both_ x ON x.a = q.seen),
 g AS (SELECT r.*, coalesce(least(r.seq, m), r.seq) AS group_id FROM r LEFT JOIN (SELECT id, min(seen) AS m FROM reach GROUP BY 1) x ON x.id = r.seq)"""


@query("merged_page_rows", "J19 A24 A12 U2", _rec(f", {_PAGE} SELECT group_id, arg_min(name, 1e9 * (1 - confidence) + seq) AS name, max(length(description)) AS desc_len, max(confidence)::double AS confidence, count(*) AS merged_from, array_to_string(list_sort(list(DISTINCT method)), '|') AS methods, "
       "array_to_string(list_sort(list_distinct(flatten(list(tags)))), '|') AS tags FROM g GROUP BY 1"))
def _(spark, sf):
    rows = page_rows(spark, sf)
    roots = graph.components(R.page_links(rows))
    grouped = rows.join(roots.select(F.col("id").alias("seq"), "component"), "seq", "left").withColumn("group_id", F.coalesce("component", "seq"))
    out = merge.merge_places(grouped)
    return out.select("group_id", "name", F.length("description").alias("desc_len"), "confidence", "merged_from", J("methods").alias("methods"), J("tags").alias("tags"))
