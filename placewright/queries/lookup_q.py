"""Rule-table joins. The grammar is derived from nation (categories) and part names (synonyms)."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import geo as G
from ..functions import scoring as SC
from ..operators import lookups as L
from ..operators import similarity as SIM
from ..plans import curation as C
from ..sources import readers
from ..sources.readers import table
from . import sqltext as S
from .inputs import pick, places, with_places
from .registry import query

J = lambda c: F.concat_ws("|", c)

ADJ, NOUN = "red|small|hot|blue|large|old|cold|new", "plate|widget|ring|rod|gizmo|bolt|gear|anvil"
TAG_ROWS = {"id": "c_custkey", "tags": f"split(concat({pick(ADJ, 'c_custkey')}, ' ', {pick(NOUN, 'floor(c_custkey / 8)')}, ',nation_', cast(c_custkey % 30 as string), ',', upper({pick(ADJ, 'c_custkey')}), ' ', {pick(NOUN, 'c_custkey')}, ',odd tag'), ',')"}
TAG_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in TAG_ROWS.items()) + " FROM customer"
DIM = {"category": "lower(n_name)", "level": "case when n_regionkey < 2 then 'A' else 'B' end", "priority": "cast(n_nationkey % 7 as int)", "description": "concat('all about ', lower(n_name))", "ord": "cast(n_nationkey as int)"}
SYN = {"synonym": "p_name", "language": "case when p_partkey % 2 = 0 then 'en' else 'th' end", "category": "concat('nation_', cast(p_partkey % 25 as string))", "ord": "cast(p_partkey as int)"}
GRAMMAR_SQL = ("WITH tag_dim AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DIM.items()) + " FROM nation), syn_dim AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SYN.items())
               + f" FROM part), syn AS (SELECT lower(synonym) AS word, arg_max(category, ord) AS category FROM syn_dim GROUP BY 1), rows AS ({TAG_SQL}), "
               "one AS (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM rows), found AS (SELECT id, pos, tag, coalesce(d.category, s.category) AS category, lv.level FROM one "
               "LEFT JOIN tag_dim d ON d.category = tag LEFT JOIN syn s ON s.word = lower(tag) LEFT JOIN tag_dim lv ON lv.category = coalesce(d.category, s.category)) ")


def grammar(spark, sf):
    tag_dim = table(spark, sf, "nation").selectExpr(*[f"{e} AS {n}" for n, e in DIM.items()])
    syn_dim = table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in SYN.items()])
    return tag_dim, syn_dim, L.synonym_map(tag_dim, syn_dim)


def tag_rows(spark, sf):
    return table(spark, sf, "customer").selectExpr(*[f"{e} AS {n}" for n, e in TAG_ROWS.items()])


@query("tags_to_categories", "J2 F45", GRAMMAR_SQL + """SELECT id, string_agg(v, '|' ORDER BY p) AS tags FROM (SELECT id, arg_min(coalesce(category, tag), pos) AS v, min(pos) AS p FROM found GROUP BY id, lower(coalesce(category, tag))) GROUP BY id""")
def _(spark, sf):
    tag_dim, _, syn = grammar(spark, sf)
    return L.normalize_tags(tag_rows(spark, sf), "id", "tags", tag_dim, syn).select("id", J("canonical").alias("tags"))


@query("tags_validated", "F46", GRAMMAR_SQL + """SELECT id, 4 AS total_tags, sum((level = 'A')::int) AS level_a, sum((level = 'B')::int) AS level_b, sum((level IS NULL)::int) AS unknown,
 sum(coalesce(level = 'A', false)::int) >= 1 AS is_valid FROM (SELECT id, coalesce(level, NULL) AS level FROM found) GROUP BY id""".replace("sum((level = 'A')::int)", "sum(coalesce(level = 'A', false)::int)").replace("sum((level = 'B')::int)", "sum(coalesce(level = 'B', false)::int)"))
def _(spark, sf):
    tag_dim, _, syn = grammar(spark, sf)
    return L.validate_tags(tag_rows(spark, sf), "id", "tags", tag_dim, syn).select("id", "total_tags", "level_a", "level_b", "unknown", "is_valid")


@query("tags_suggested", "F48", GRAMMAR_SQL + """, q AS (SELECT DISTINCT tag AS word, list_distinct(string_split(lower(tag), ' ')) AS w FROM one), s AS (SELECT DISTINCT category, list_distinct(string_split(lower(synonym), ' ')) AS w FROM syn_dim)
SELECT word, category, rank FROM (SELECT word, category, row_number() OVER (PARTITION BY word ORDER BY category) AS rank FROM (SELECT DISTINCT word, category FROM q, s
 WHERE len(list_intersect(q.w, s.w)) / len(list_distinct(list_concat(q.w, s.w))) > 0.6)) WHERE rank <= 3""")
def _(spark, sf):
    _, syn_dim, _ = grammar(spark, sf)
    words = tag_rows(spark, sf).select(F.explode("tags").alias("word"))
    return L.suggest_categories(words, "word", syn_dim)


@query("tags_described", "F49", GRAMMAR_SQL + """SELECT id, tag, f.category, f.level, d.priority, coalesce(e.n, 0) AS n_synonyms FROM found f LEFT JOIN tag_dim d ON d.category = f.category
 LEFT JOIN (SELECT category, count(*) AS n FROM syn_dim WHERE language = 'en' GROUP BY 1) e ON e.category = f.category WHERE f.category IS NOT NULL""")
def _(spark, sf):
    tag_dim, syn_dim, syn = grammar(spark, sf)
    one = tag_rows(spark, sf).select("id", F.explode("tags").alias("tag"))
    out = L.tag_info(one, "tag", tag_dim, syn_dim, syn).where("category is not null")
    return out.select("id", "tag", "category", "level", "priority", F.coalesce(F.size("synonyms"), F.lit(0)).alias("n_synonyms"))


@query("related_tags", "W14", GRAMMAR_SQL + """SELECT category, related, rank FROM (SELECT a.category, b.category AS related, row_number() OVER (PARTITION BY a.category ORDER BY b.priority, b.ord) AS rank
 FROM tag_dim a JOIN tag_dim b ON a.level = b.level AND a.category <> b.category AND abs(a.priority - b.priority) <= 2) WHERE rank <= 5""")
def _(spark, sf):
    return L.related_tags(grammar(spark, sf)[0])


@query("tag_search", "W15", GRAMMAR_SQL + """SELECT tag, score, level, priority FROM (SELECT d.category AS tag, CASE WHEN contains(d.category, 'n_1') THEN 2e0 ELSE 0e0 END + CASE WHEN contains(description, 'n_1') THEN 1e0 ELSE 0e0 END AS score, level, priority, ord FROM tag_dim d)
 WHERE score > 0 ORDER BY score DESC, ord LIMIT 10""")
def _(spark, sf):
    tag_dim, syn_dim, _ = grammar(spark, sf)
    return L.search_tags(tag_dim, syn_dim, "N_1")


@query("tag_statistics", "A15", GRAMMAR_SQL + """SELECT t.*, s.*, round(total_synonyms / total_categories, 2) AS average_synonyms FROM (SELECT count(*) AS total_categories, sum((level = 'A')::int) AS level_a_count, sum((level = 'B')::int) AS level_b_count FROM tag_dim) t,
 (SELECT count(*) AS total_synonyms, sum((language = 'en')::int) AS en_synonyms, sum((language = 'th')::int) AS th_synonyms FROM syn_dim) s""")
def _(spark, sf):
    tag_dim, syn_dim, _ = grammar(spark, sf)
    return L.tag_statistics(tag_dim, syn_dim)


_CHOSEN = "Art,cinema|music|nightlife,food|wellness|unknown|food_drinks,ART_EXHIBITS|entertainment"
_CHOSEN_SQL = f"split({pick(_CHOSEN, 'c_custkey')}, ',')"


def _pairs_sql(tbl):
    return ", ".join(f"({S.q(k)}, {S.q(v)})" for k, vs in tbl.items() for v in vs)


@query("category_facets", "J3 J4", f"""WITH one AS (SELECT DISTINCT c_custkey AS id, lower(unnest({_CHOSEN_SQL})) AS category FROM customer), a(category, alias) AS (VALUES {_pairs_sql(rules.CATEGORY_ALIASES)}), f(category, flag) AS (VALUES {_pairs_sql(rules.CATEGORY_FLAGS)}),
 wide AS (SELECT * FROM one UNION SELECT id, alias FROM one JOIN a USING (category)), g AS (SELECT id, list_sort(list(DISTINCT category)) AS categories, list_sort(list(DISTINCT flag) FILTER (flag IS NOT NULL)) AS flags FROM wide LEFT JOIN f USING (category) GROUP BY id)
 SELECT id, array_to_string(categories, '|') AS categories, coalesce(array_to_string(flags, '|'), '') AS flags, CASE WHEN flags IS NOT NULL AND len(flags) > 0 THEN array_to_string(flags, '|') WHEN len(list_filter(categories, lambda c: contains(c, 'art'))) > 0 THEN 'art' ELSE 'all' END AS safe_flags FROM g""")
def _(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(_CHOSEN_SQL).alias("chosen"))
    out = L.category_facets(df, "id", "chosen")
    return out.select("id", J("categories").alias("categories"), J("flags").alias("flags"), J(L.never_empty_flags("flags", "categories")).alias("safe_flags"))


@query("category_tags", "J5 S2", """WITH d AS (SELECT 'Brand#' || b AS id, list_sort(list(DISTINCT p_type)) AS tags FROM (SELECT replace(p_brand, 'Brand#', '') AS b, p_type FROM part) GROUP BY 1)
 SELECT c_custkey AS id, array_to_string(list_sort(list(DISTINCT t)), '|') AS tags FROM (SELECT c_custkey, unnest(d.tags) AS t FROM customer JOIN d ON d.id IN ('Brand#' || (c_custkey % 25 + 1)::varchar, 'Brand#' || (c_custkey % 7 + 1)::varchar)) WHERE t IN ('SMALL', 'PROMO', 'LARGE') GROUP BY 1""")
def _(spark, sf):
    dim = table(spark, sf, "part").groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_set("p_type")).alias("tags"))
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.array(*[F.concat(F.lit("Brand#"), (F.col("c_custkey") % n + 1).cast("string")) for n in (25, 7)]).alias("chosen"))
    return L.category_tags(df, "cust", "chosen", dim, ["SMALL", "PROMO", "LARGE"]).select(F.col("cust").alias("id"), J("tags").alias("tags"))


@query("sources_of_category", "J6 P13", "SELECT c_mktsegment AS segment, r_name AS source, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, sf):
    cities = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("source"))
    df = table(spark, sf, "customer").select("c_mktsegment", F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string")).alias("name"))
    return L.attach_by_name(df, "name", cities, "n_name").groupBy(F.col("c_mktsegment").alias("segment"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("source_scores", "J7", with_places("SELECT coalesce(domain, '') AS domain, round(CASE WHEN domain = '' THEN 0.5e0 WHEN domain = 'timeout.com' THEN 0.9e0 WHEN domain = 'www.bk-magazine.com' THEN 0.85e0 WHEN domain = 'coconuts.co' THEN 0.75e0 ELSE 0.5e0 END + CASE WHEN domain <> '' AND starts_with(url, 'https://') THEN 0.05e0 ELSE 0e0 END, 4) AS score, count(*) AS n FROM places GROUP BY 1, 2"))
def _(spark, sf):
    return places(spark, sf).groupBy("domain", F.round(SC.source_reliability("domain", "url"), 4).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("contained_names", "J8", with_places("SELECT p.seq AS seq, arg_min(n_name, n_nationkey) AS hit FROM (SELECT seq, lower('x ' || CASE WHEN seq % 3 = 0 THEN 'NATION_' || (seq % 40)::varchar || ' inn' ELSE name END) AS t FROM places) p LEFT JOIN nation n ON contains(p.t, lower(n_name)) GROUP BY 1"))
def _(spark, sf):
    dim = table(spark, sf, "nation").select(F.lower("n_name").alias("k"), "n_name", "n_nationkey")
    text = F.concat(F.lit("x "), F.when(F.col("seq") % 3 == 0, F.concat(F.lit("NATION_"), (F.col("seq") % 40).cast("string"), F.lit(" inn"))).otherwise(F.col("name")))
    out = SIM.contains_lookup(places(spark, sf).select("seq", text.alias("t")), "seq", "t", dim, "k", "n_nationkey", ["n_name"])
    return out.select("seq", F.col("n_name").alias("hit"))


AREAS = ["sukhumvit", "silom", "siam", "thonglor", "chatuchak", "yaowarat", "ari", "asoke"]
_AREA_ROWS = [(a, s, i * 4 + j) for i, a in enumerate(AREAS) for j, s in enumerate([a, f"{a} road", f"{a} area", f"{a} district"])]
AREA_SQL = "area_dim(area, synonym, ord) AS (VALUES " + ", ".join(f"({S.q(a)}, {S.q(s)}, {o})" for a, s, o in _AREA_ROWS) + ")"


def area_dim(spark):
    return readers.area_synonyms(spark, readers.plain_area_synonyms(AREAS))


@query("areas_standardised", "J9 J9b", with_places(", " + AREA_SQL + """, sp AS (SELECT DISTINCT lower(trim(area)) AS a FROM places), ex AS (SELECT a, arg_min(d.area, ord) AS std FROM sp JOIN area_dim d ON a = synonym GROUP BY a),
 pt AS (SELECT a, arg_min(d.area, ord) AS std FROM sp JOIN area_dim d ON contains(a, synonym) OR contains(synonym, a) GROUP BY a)
 SELECT seq, coalesce(upper(substr(coalesce(ex.std, pt.std), 1, 1)) || substr(coalesce(ex.std, pt.std), 2), area) AS standard_area, ex.std IS NOT NULL AS is_known FROM places LEFT JOIN ex ON ex.a = lower(trim(area)) LEFT JOIN pt ON pt.a = lower(trim(area))"""))
def _(spark, sf):
    dim = area_dim(spark)
    return L.exact_areas(L.standard_areas(places(spark, sf), "area", dim), "area", dim).select("seq", "standard_area", "is_known")


_TYPE_CASES = " ".join(f"WHEN {S.has('lower(area)', w)} THEN {S.q(k)}" for w, k in rules.AREA_TYPES)


@query("area_type_statistics", "A32", with_places(", " + AREA_SQL + f""", used AS (SELECT DISTINCT d.area FROM area_dim d JOIN places p ON lower(trim(p.area)) = synonym), per AS (SELECT area, count(*) AS n FROM area_dim SEMI JOIN used USING (area) GROUP BY 1)
 SELECT CASE {_TYPE_CASES} ELSE 'other' END AS type, count(*) AS areas, sum(n)::bigint AS synonyms, round(avg(n), 2) AS mean_synonyms FROM per GROUP BY 1"""))
def _(spark, sf):
    dim = area_dim(spark)
    named = dim.join(places(spark, sf).select(F.lower(F.trim("area")).alias("synonym")).distinct(), "synonym", "left_semi").select("area")
    return L.area_types(dim.join(named, "area", "left_semi"))


@query("area_statistics", "A32", with_places(", " + AREA_SQL + " SELECT d.area, count(DISTINCT synonym) AS n_synonyms, count(DISTINCT seq) AS n_places FROM area_dim d LEFT JOIN places p ON lower(trim(p.area)) = synonym GROUP BY 1"))
def _(spark, sf):
    dim = area_dim(spark)
    used = places(spark, sf).groupBy(F.lower(F.trim("area")).alias("synonym")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(used, "synonym", "left").groupBy("area").agg(F.count_distinct("synonym").alias("n_synonyms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_places"))


_IN = " OR ".join(f"sqrt(pow(geo_lat - {la}, 2) + pow(geo_lng - {ln}, 2)) <= {r}" for _, la, ln, r in rules.DISTRICTS)


@query("districts_found", "J15 PL4 F64", with_places("SELECT seq, array_to_string(list_filter([" + ", ".join(f"CASE WHEN sqrt(pow(geo_lat - {la}, 2) + pow(geo_lng - {ln}, 2)) <= {r} THEN {S.q(n)} END" for n, la, ln, r in rules.DISTRICTS)
       + f"], lambda x: x IS NOT NULL), '|') AS districts, coalesce(geo_lat BETWEEN 13.5 AND 14.0 AND geo_lng BETWEEN 100.3 AND 100.8 AND ({_IN}), false) AS is_valid_geo, CASE price_level WHEN 0 THEN 'budget' WHEN 1 THEN 'budget' WHEN 4 THEN 'high_end' ELSE 'mid_range' END AS price_band FROM places"))
def _(spark, sf):
    return C.enrich_geo(places(spark, sf)).select("seq", J("districts").alias("districts"), "is_valid_geo", "price_band")


@query("nearest_districts", "J20", with_places("SELECT seq, arg_min(n, sqrt(pow(geo_lat - la, 2) + pow(geo_lng - ln, 2))) AS district FROM places, (VALUES " + ", ".join(f"({S.q(n)}, {la}, {ln})" for n, la, ln, _ in rules.DISTRICTS) + ") d(n, la, ln) WHERE geo_lat IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return places(spark, sf).where("geo_lat is not null").select("seq", G.nearest_district("geo_lat", "geo_lng")["name"].alias("district"))
