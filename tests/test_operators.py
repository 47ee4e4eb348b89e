"""Joins, ranks, merges and tables against brute force, with hot keys salted."""
import datetime as dt
import itertools
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from placewright.operators import extract as E
from placewright.operators import facets as FA
from placewright.operators import graph, lookups, merge, ranking, reports, resolve, search, similarity, tables
from placewright.operators.quantiles import exact_percentiles
from placewright.operators.skew import salted_join
from placewright.session import cut_lineage

from .conftest import rows

HOT = 5  # every key with five rows or more counts as hot in these tests


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def names(n, seed=1):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(3, 24))).strip() or "a" for _ in range(n // 3)]
    out = []
    for i in range(n):
        s = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            s.insert(rnd.randint(0, len(s)), rnd.choice("abcde"))
        out.append("".join(s))
    return out + ["aaaaaaaaaaaa", "aaaaaaaaaaab", "aaaaaaaaaaaa"]


def expect_pairs(texts, close):
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    out = {(first[t], i) for i, t in enumerate(texts) if first[t] != i}
    for (a, i), (b, j) in itertools.combinations(sorted(first.items(), key=lambda kv: kv[1]), 2):
        if close(a, b):
            out.add((i, j))
    return out


@pytest.mark.parametrize("ratio", [0.8, 0.86, 0.9])
def test_similar_texts_complete(spark, ratio):
    texts = names(120)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {tuple(r) for r in similarity.similar_texts(df, "id", "t", ratio, hot_rows=HOT).select("id_a", "id_b").collect()}
    assert got == expect_pairs(texts, lambda a, b: 1 - lev(a, b) / max(len(a), len(b)) >= ratio)


def test_similar_texts_gestalt(spark):
    texts = names(90, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {tuple(r) for r in similarity.similar_texts(df, "id", "t", 0.86, metric="gestalt", hot_rows=HOT).select("id_a", "id_b").collect()}
    assert got == expect_pairs(texts, lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.86)


def test_gestalt_candidates_of_a_common_word(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("aeioubdfgklmnprs") for _ in range(14)) + " restaurant" for _ in range(150)]
    texts += [t[:i % 14] + "x" + t[i % 14 + 1 + i % 2:] for i, t in enumerate(texts[:30])]
    nodes = spark.createDataFrame(list(enumerate(texts)), "_id long, _t string")
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if SequenceMatcher(None, texts[i], texts[j]).ratio() >= 0.86}
    got = {tuple(r) for r in similarity.text_candidates(nodes, 0.28, [], replaced=False).collect()}
    assert len(want) >= 30 and want <= got and len(got) < 1000  # of 16,110 pairs, most of which met and passed before


def test_similar_sets(spark):
    rnd = random.Random(5)
    sets = [sorted(rnd.sample("abcdefgh", rnd.randint(1, 7))) for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, w array<string>")
    got = {tuple(r) for r in similarity.similar_sets(df, "id", "w", 0.7, hot_rows=HOT).select("id_a", "id_b").collect()}
    texts = ["".join(s) for s in sets]
    assert got == expect_pairs(texts, lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) > 0.7)


def test_nearest_within(spark):
    rnd = random.Random(2)
    pts = [(i, round(rnd.uniform(0, 0.02), 5), round(rnd.uniform(0, 0.02), 5)) for i in range(400)] + [(400, 0.5, 0.5), (401, 0.5, 0.5), (402, None, 1.0)]
    df = spark.createDataFrame(pts, "seq long, x double, y double")
    want = {}
    for i, x, y in pts:
        best = min(((math.dist((x, y), (a, b)), j) for j, a, b in pts if x is not None and a is not None and j < i), default=None)
        if best and best[0] <= 0.001:
            want[i] = best[1]
    got = {r["seq"]: r["match"] for r in resolve.nearest_within(df, "x", "y", 0.001, hot_rows=HOT).collect()}
    assert got == want


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [tuple(sorted(rnd.sample(range(200, 260), 2))) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "id_a long, id_b long"), hot_rows=HOT).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_salted_join_equals_plain(spark):
    left = spark.range(200).select(F.when(F.col("id") < 120, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        got, want = salted_join(left, right, ["k"], ["id"], how, HOT).select("k", "id", "v"), left.join(right, "k", how).select("k", "id", "v")
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert salted_join(left, right, ["k"], ["id"], "left_anti", HOT).count() == left.join(right, "k", "left_anti").count()
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], ["id"], "full")


@pytest.mark.parametrize("parts", [1, 6])
def test_global_rank(spark, parts):
    rnd = random.Random(9)
    data = [(i, rnd.choice([1.0, 2.0, 2.0, 2.0, 3.5, None])) for i in range(300)]
    df = spark.createDataFrame(data, "id long, s double").repartition(parts)
    order = sorted(data, key=lambda r: (-(r[1] if r[1] is not None else -math.inf), r[0]))
    got = {r["id"]: r["rank"] for r in ranking.global_rank(df, "s", "id").collect()}
    assert got == {r[0]: i for i, r in enumerate(order)}
    assert ranking.top_percent(df, "s", "id", 0.1).count() == 30 and ranking.top_percent(df, "s", "id", 0.0).count() == 0


def test_top_percent_small(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("s"))
    assert rows(ranking.top_percent(df, "s", "id", 0.2), "rank") == [(0,), (1,)]
    assert ranking.top_percent(df, "s", "id", 0.001).count() == 1


def test_pages(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 13)
    order = [F.desc("v"), F.asc("id")]
    want = [r["id"] for r in df.orderBy(*order).collect()]
    got = [r["id"] for r in ranking.page_of(df, order, 3, 50).collect()]
    assert got == want[100:150]
    assert [r["id"] for r in ranking._deep_page(df, order, 700, 90).collect()] == want[700:790]


def test_rank_of_odd_scores(spark):
    """Infinite and null scores, and text ids."""
    inf = float("inf")
    data = [(f"id{k:04d}", [inf, -inf, None, 1.0, 2.0, 2.0][k % 6]) for k in range(600)]
    got = [r["id"] for r in ranking.global_rank(spark.createDataFrame(data, "id string, s double"), "s", "id").orderBy("rank").collect()]
    assert got == [i for i, s in sorted(data, key=lambda x: (x[1] is None, -(x[1] if x[1] is not None else 0), x[0]))]


def test_caps_are_gone(spark):
    """Every heavy key is split and every long list is cut, whatever their number."""
    from placewright.operators.facets import facet_chunks
    from placewright.operators.skew import salted_join
    left = spark.range(3000).select((F.col("id") % 1500).alias("k"), "id")
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    out = salted_join(left, right, ["k"], ["id"], at_least=2, salts=4)
    assert out.count() == 3000 and out.where("w != 2 * k").count() == 0
    posts = spark.range(50).select(F.lit("c").alias("city"), F.current_date().alias("day"), F.lit("flag").alias("kind"), (F.col("id") % 5).cast("string").alias("key"),
                                   F.col("id").cast("string"))
    chunks = facet_chunks(posts, 2)
    assert chunks.agg(F.sum("n")).first()[0] == 50 and chunks.groupBy("key").count().where("count < 2").count() == 0


def test_percentiles(spark):
    rnd = random.Random(1)
    data = [("a", rnd.expovariate(0.01)) for _ in range(500)] + [("b", 7.0)] * 40 + [("c", 100.0), ("c", 200.0)] + [("d", 1e12)] + [("d", rnd.random()) for _ in range(99)]
    df = spark.createDataFrame(data, "k string, v double")
    want = {r["k"]: (r["x"], r["y"]) for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("x"), F.percentile("v", 0.95).alias("y")).collect()}
    got = {r["k"]: (r["p50"], r["p95"]) for r in exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert got["c"] == pytest.approx((150.0, 195.0))


PLACES = [
    (0, "Blue Lotus", "bangkok", "a.com", "1 Silom Road", 13.70, 100.50), (1, "The Blue Lotus Restaurant", "bangkok", "a.com", "other", 13.70, 100.50),
    (2, "Blue Lotuss", "bangkok", "a.com", "x", 13.90, 100.10), (3, "Green House Gallery Hall", "bangkok", "b.com", "1 Silom Road", 13.1, 100.1),
    (4, "Totally Different", "bangkok", "c.com", "zz", 13.1002, 100.1003), (5, "Blue Lotus", "phuket", "a.com", "yy", 7.0, 98.0), (6, "", "bangkok", "", "", None, None),
]


def test_matching(spark):
    df = spark.createDataFrame(PLACES, "seq long, name string, city string, domain string, address string, geo_lat double, geo_lng double")
    got = {r["seq"]: (r["match"], r["strategy"]) for r in resolve.match_rows(df, hot_rows=HOT).collect()}
    assert got == {1: (0, "identity"), 2: (0, "fuzzy"), 3: (0, "address"), 4: (3, "geo")}
    everywhere = {r["seq"]: r["match"] for r in resolve.match_rows(df, block_on=[], hot_rows=HOT).collect()}
    assert everywhere[5] == 0
    strict = {r["seq"]: r["strategy"] for r in resolve.match_rows(df, name_ratio=0.95, tolerance=0.0001, hot_rows=HOT).collect()}
    assert 2 not in strict and 4 not in strict
    out = resolve.resolve(df, resolve.match_rows(df))
    assert {r["seq"]: r["root"] for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6}
    kept = out.where(~F.col("is_duplicate")).select(*df.columns)
    assert resolve.match_rows(kept).count() == 0  # a second run finds nothing


def test_merge_events(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(0, "a", "Show", "short", None, "u0", "other", t0 + dt.timedelta(days=9), ["A", "b"], ["x"], {"art": False}, 0),
            (1, "b", "Show", "a longer text", "data:image/svg+xml;x", "u1", "timeout_bkk", t0, ["b", "c"], ["y"], {"art": True}, 0),
            (2, "c", "Show", None, "i.png", "u2", "bk_magazine", t0 + dt.timedelta(days=1), [], ["x"], {}, 0), (3, "d", "Solo", None, None, "u3", "z", t0, [], [], {}, 3)]
    df = spark.createDataFrame(data, "seq long, id string, title string, desc string, image string, url string, source string, fetched_at timestamp, tags array<string>, categories array<string>, attrs map<string,boolean>, group_id long")
    df = df.withColumn("start", F.col("fetched_at")).withColumn("venue", F.lit("v"))
    m = {r["group_id"]: r for r in merge.merge_events(df).collect()}
    assert len(m) == 2 and m[0]["url"] == "u1" and m[0]["desc"] == "a longer text" and m[0]["image"] == "i.png" and m[0]["tags"] == ["a", "b", "c"]
    assert m[0]["categories"] == ["x", "y"] and m[0]["sources"] == ["other", "timeout_bkk", "bk_magazine"] and m[0]["attrs"] == {"art": True} and m[0]["merged_count"] == 3
    assert m[0]["fetched_at"] == t0 + dt.timedelta(days=9)


def test_upsert_and_replace(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    base = spark.createDataFrame([("e-1", "old", t[4]), ("e-2", "keep", t[1])], "id string, v string, fetched_at timestamp")
    batch = spark.createDataFrame([("e-1", "new", t[2], 1), ("e-3", "first", t[3], 1), ("e-3", "last", t[2], 2)], "id string, v string, fetched_at timestamp, ord long")
    once = tables.upsert_events(base, batch, order="ord")
    assert rows(once, "id", "v", "fetched_at") == [("e-1", "new", t[4]), ("e-2", "keep", t[1]), ("e-3", "last", t[3])]
    assert rows(tables.upsert_events(once, batch, order="ord"), "id", "v", "fetched_at") == rows(once, "id", "v", "fetched_at")
    schema = "id string, source string, source_url string, ord long"
    a = spark.createDataFrame([("1", "s", "u", 0), ("2", "s", "w", 1), ("3", None, None, 2)], schema)
    b = spark.createDataFrame([("4", "s", "u", 0), ("2", "s", "z", 1)], schema)
    assert rows(tables.insert_or_replace(a, b, "ord"), "id", "source_url") == sorted([("2", "z"), ("3", None), ("4", "u")], key=lambda r: r[0])


def test_freshness_and_rebuild(spark):
    df = spark.createDataFrame([("2024-01-01 11:45:00",), ("2024-01-01 11:38:00",), ("2024-01-01 11:00:00",), (None,)], "b string")
    got = [r[0] for r in df.select(FA.freshness_state(F.col("b"), F.lit("2024-01-01 12:00:00"))).collect()]
    assert got == ["fresh", "stale", "miss", "miss"]
    ev = spark.createDataFrame([("c", "2024-01-01", "2024-01-03", "1", ["a"])], "city string, s string, e string, id string, flags array<string>")
    out = FA.rebuild(ev, "city", "s", "e", "id", "flags", ["a", "b"], dt.date(2024, 1, 1), 4)
    assert rows(out.where("key = 'a'"), "n") == [(0,), (1,), (1,), (1,)] and out.count() == 8


def test_facet_chunks_bounded(spark):
    r = spark.range(1000).select(F.lit("c").alias("city"), F.lit("2024-01-01").alias("day"), F.lit("flag").alias("kind"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("key"), F.col("id").cast("string").alias("id"))
    chunks = FA.facet_chunks(r, 100)
    assert chunks.agg(F.sum("n")).first()[0] == 1000 and chunks.agg(F.max("n")).first()[0] < 200


def test_quality_report(spark):
    data = [("a" if i < 6 else "b", "x" if i < 6 else None, "y" if i < 3 else None, "i" if i < 5 else None, "z" * (i + 2) if i % 2 == 0 else None) for i in range(10)]
    df = spark.createDataFrame(data, "source string, start string, end string, image string, desc string")
    r = reports.event_quality(df, [], "start", "end", "image", "desc").first()
    assert (r["start_pct"], r["end_pct"], r["image_pct"], r["avg_desc_len"], r["median_desc_len"]) == (60.0, 30.0, 50.0, 6.0, 6.0)


def test_tag_rules(spark):
    tag_dim = spark.createDataFrame([("food_dining", "A", 1, "", 0), ("nightlife", "A", 2, "", 1), ("transportation", "B", 6, "", 2)], "category string, level string, priority int, description string, ord int")
    syn = spark.createDataFrame([("restaurant", "en", "food_dining", 0), ("bar", "en", "food_dining", 1), ("bar", "en", "nightlife", 2), ("taxi", "en", "transportation", 3)], "synonym string, language string, category string, ord int")
    df = spark.createDataFrame([("1", ["Restaurant", "food_dining", "bar", "Zzz"]), ("2", []), ("3", ["taxi"])], "id string, tags array<string>")
    last = lookups.synonym_map(tag_dim, syn)
    got = {r["id"]: r["canonical"] for r in lookups.normalize_tags(df, "id", "tags", tag_dim, last).collect()}
    assert got == {"1": ["food_dining", "nightlife", "Zzz"], "2": [], "3": ["transportation"]}
    first = lookups.synonym_map(tag_dim, syn, "first")
    assert {r["id"]: r["canonical"] for r in lookups.normalize_tags(df, "id", "tags", tag_dim, first).collect()}["1"] == ["food_dining", "Zzz"]
    v = {r["id"]: (r["is_valid"], r["unknown"], r["level_b"]) for r in lookups.validate_tags(df, "id", "tags", tag_dim, last).collect()}
    assert v == {"1": (True, 1, 0), "2": (False, 0, 0), "3": (False, 0, 1)}


def test_extraction(spark):
    page = ('<script type="application/ld+json">[{"@type":"MusicEvent","name":"Gig","location":"Hall"},{"@type":"Thing"}]</script><script type="application/ld+json">{bad</script>'
            '<div class="card"><h3>One</h3><img src="1.jpg"></div><div class="card x"><h3>Two <b>bold</b></h3></div>')
    df = spark.createDataFrame([(1, "https://s.com/p", page)], "page_id long, url string, html string")
    ev = E.event_details(E.json_ld_events(df)).collect()
    assert [(r["title"], r["venue"]) for r in ev] == [("Gig", "Hall")]
    cards = E.css_rows(df, ".card", {"name": "h3", "image": "img@src"}).orderBy("pos").collect()
    assert [(r["name"], r["image"]) for r in cards] == [("One", "1.jpg"), ("Two bold", None)]


def test_search_terms(spark):
    df = spark.createDataFrame([(1, "jazz bar bar", None), (2, "jazz", None), (3, None, ["bar", "Jazz"]), (4, None, None)], "id long, t string, g array<string>")
    p, n = search.build_postings(df, "id", ["t"], ["g"]), search.collection_size(df, "id", ["t"], ["g"])
    assert {r["id"] for r in search.match_all(p, n, "Jazz bar").collect()} == {1, 3} and search.match_all(p, n, " ").count() == 0


def test_nearest_within_meets_few_points(spark, monkeypatch):
    """Dense points: pairs that the levels look at stay a few per point."""
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, rnd.uniform(0, 0.008), rnd.uniform(0, 0.008)) for i in range(4000)], "seq long, x double, y double")
    met, join = [], resolve.measured_join

    def counted(*args):
        out = join(*args)
        met.append(out.where("p < _id").count())
        return out
    monkeypatch.setattr(resolve, "measured_join", counted)
    assert resolve.nearest_within(df, "x", "y", 0.001).count() >= 3900
    assert sum(met) < 25 * 4000, met


def test_postings_are_cut_after_the_shuffle(spark):
    """Texts travel, not their words, and are cut once; rows of one id and length are one posting, empty and null texts none."""
    df = spark.createDataFrame([(1, "Jazz bar bar"), (1, "bar jazz jazz"), (1, "bar"), (2, " .,"), (3, None), (None, "Bar")], "id long, t string")
    out = search.build_postings(df, "id", ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("split(") == 1 and plan.index("split(") < plan.index("Exchange")
    assert sorted(((r["id"] or 0, r["doc_len"], r["term"], r["tf"]) for r in out.collect())) == [(0, 1, "bar", 1), (1, 1, "bar", 1), (1, 3, "bar", 3), (1, 3, "jazz", 3)]


def test_similar_texts_low_ratio(spark):
    texts = names(60, 9) + ["a", "b", "ab", "abc", "xabc", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {tuple(r) for r in similarity.similar_texts(df, "id", "t", 0.6, hot_rows=HOT).select("id_a", "id_b").collect()}
    want = expect_pairs(texts, lambda a, b: a and b and 1 - lev(a, b) / max(len(a), len(b)) >= 0.6)
    assert got == want


@pytest.mark.parametrize("ratio", [0.6, 0.8, 0.86])
def test_similar_texts_of_a_crowd(spark, ratio):
    """Words that many texts share at their ends and starts: complete, and their segments are not joined alone."""
    texts = [t + " restaurant" for t in names(50, 4)] + ["the old " + t for t in names(40, 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {tuple(r) for r in similarity.similar_texts(df, "id", "t", ratio, hot_rows=HOT, crowd=3).select("id_a", "id_b").collect()}
    assert got == expect_pairs(texts, lambda a, b: 1 - lev(a, b) / max(len(a), len(b)) >= ratio)
    rows = spark.createDataFrame([(i, f"{i * 7919:014d} restaurant") for i in range(40)], "_id long, _t string").selectExpr("*", "length(_t) as _n", "3 as _k")
    own = similarity.own_keys(rows, "", "_k", F.col("_id").alias("_id_a"), F.col("_i"))
    crowds = own.groupBy("_key").agg(F.count(F.lit(1)).alias("_f")).where("_f >= 40")
    assert {tuple(r["_held"]) for r in similarity._crowded(rows, own, crowds).collect()} == {(1, 4)}


def test_texts_with_long_common_parts_are_compared_inside_the_join(spark):
    """Titles of a few words and letters that differ: only close pairs leave the join, and the cut spreads the letters over the segments."""
    rnd = random.Random(8)
    texts = sorted({t + "".join(rnd.choice("aeioubdf") for _ in range(7)) + end for t in ("jazz night at the rooftop ", "the old food market ") for _ in range(160) for end in ("", "s")})
    nodes = spark.createDataFrame([(i, t, t[:3]) for i, t in enumerate(texts)], "_id long, _t string, b string")
    want = {(i, j) for i, j in expect_pairs(texts, lambda a, b: a[:3] == b[:3] and abs(len(a) - len(b)) <= 3 and lev(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9))}
    for crowd in (20, 10_000):
        assert {tuple(r) for r in similarity.text_candidates(nodes, 0.1, ["b"], crowd=crowd).collect()} == want
    same = [t for t in texts if len(t) == 33 and t.startswith("jazz")]
    places = similarity.best_cut(same, 3)
    assert places[0] == 1 and places[-1] == 34 and places[1] > 26 and sorted(set(places)) == places and len(places) == 5
    shared = [sum(a[i - 1:j - 1] == b[i - 1:j - 1] for a, b in itertools.combinations(same, 2)) for i, j in zip(places, places[1:])]
    assert sum(shared) < 0.3 * len(same) * (len(same) - 1) / 2  # of segments of equal size three are the same everywhere


def test_candidates_grow_with_the_rows(spark):
    """Ten times the rows, under fifteen times the candidates: texts of random letters with a common tail, sets of common and rare words."""
    def letters(n):
        rnd = random.Random(n)
        stems = ["".join(rnd.choice("aeioubdfgklmnprs") for _ in range(13)) for _ in range(n // 2)]
        return [(i, s + end) for i, s in enumerate(s for stem in stems for s in (stem, stem + "s")) for end in [" bar"]]

    def sets(n):
        rnd = random.Random(n)
        base = [[f"c{rnd.randrange(50)}" for _ in range(10)] + [f"r{rnd.randrange(20 * n)}" for _ in range(30)] for _ in range(n // 2)]
        return [(i, w) for i, w in enumerate(w for b in base for w in (b, b[:-1] + ["other"]))]
    count = {}
    for n in (400, 4000):
        texts = spark.createDataFrame(letters(n), "_id long, _t string")
        words = spark.createDataFrame(sets(n), "_id long, w array<string>").select("_id", F.array_distinct("w").alias("_w"))
        count[n] = (similarity.text_candidates(texts, 0.14, []).count(), similarity.set_candidates(words, 0.8, []).count())
    for small, large in zip(count[400], count[4000]):
        assert small >= 200 and large < 15 * small


def test_components_of_a_long_chain(spark):
    """A chain of 100,000 in random order, a star, a clique and a loop; the edges shrink every turn."""
    order = list(range(100_000))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:])) + [(200_000, 200_000 + i) for i in range(1, 50)] + list(itertools.combinations(range(300_000, 300_006), 2)) + [(400_000, 400_000)]
    df = spark.createDataFrame(edges, "id_a long, id_b long").repartition(4)
    got = graph.components(df, hot_rows=HOT * 1000)
    assert {tuple(r) for r in got.groupBy("component").count().collect()} == {(0, 100_000), (200_000, 50), (300_000, 6), (400_000, 1)}
    rest, counts = cut_lineage(df.where("id_a != id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))), []
    for turn in range(3):
        _, rest = graph.contracted(rest, turn == 0, turn)
        counts.append(rest.count())
    assert counts[1] < 0.6 * counts[0] and counts[2] < 0.6 * counts[1]
    assert graph.components(df.limit(0)).count() == 0


def test_percentiles_of_large_groups(spark):
    """Groups larger than the sketch, with a far outlier, a heavy tail and one value for most rows; few exchanges."""
    rnd = random.Random(3)
    values = {"far": [rnd.random() for _ in range(5000)] + [1e12], "tail": [rnd.paretovariate(0.2) for _ in range(5000)], "same": [5.0] * 4000 + [float(i) for i in range(1000)],
              "two": [1.0, 2.0], "one": [-3.5]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(6)
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    out = exact_percentiles(df, ["k"], "v", points, accuracy=100)
    import numpy as np
    for r in out.collect():
        assert [r[n] for n in points] == pytest.approx([float(np.quantile(values[r["k"]], p)) for p in points.values()])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange ") <= 6
    whole = exact_percentiles(df, [], "v", points, accuracy=100).first()
    every = [v for vs in values.values() for v in vs]
    assert [whole[n] for n in points] == pytest.approx([float(np.quantile(every, p)) for p in points.values()])
    assert exact_percentiles(df.limit(0), ["k"], "v", points).count() == 0


def test_contained_texts(spark):
    """Both ways against brute force, and few candidates for many synonyms with a common word."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdef") for _ in range(n))
    inner = sorted({word(rnd.randint(1, 6)) for _ in range(150)} | {"é", "a b"})
    outer = sorted({word(rnd.randint(1, 14)) for _ in range(150)} | {"xa bx", "", "éé"})
    frame = lambda texts, name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
    got = {tuple(r) for r in lookups.contained(frame(inner, "inner"), frame(outer, "outer")).collect()}
    assert got == {(i, o) for i in inner for o in outer if i in o}
    synonyms = spark.range(100_000).select(F.concat(F.substr(F.md5(F.col("id").cast("string")), F.lit(1), F.lit(8)), F.lit(" district")).alias("inner"))
    areas = synonyms.limit(500).select(F.concat(F.lit("near "), "inner").alias("outer"))
    met = lookups.contained_candidates(synonyms, areas)
    assert 500 <= met.count() <= 500 * 60 and lookups.contained(synonyms, areas).count() == 500


def test_growing_sides_are_not_broadcast(spark):
    """Sides that grow with the rows never pass through the driver, even where their files look small."""
    from placewright.operators.skew import measured_join, salted_join
    df = spark.createDataFrame([(1, 1, "a", "t", "d", "i", "u", "s", dt.datetime(2024, 1, 1), ["x"], ["y"], {"k": True}, dt.datetime(2024, 1, 1), "v")],
                               "group_id long, seq long, id string, title string, desc string, image string, url string, source string, fetched_at timestamp, "
                               "tags array<string>, categories array<string>, attrs map<string,boolean>, start timestamp, venue string")
    a, b = spark.range(9).withColumn("v", F.col("id")), spark.range(9).withColumn("w", F.col("id"))
    matches = spark.createDataFrame([(2, 1, "geo"), (3, 2, "geo")], "seq long, match long, strategy string")

    def plan(out):
        return out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(merge.merge_events(df))
    assert "Broadcast" not in plan(measured_join(a, b, ["id"], ["v"]))
    assert "SortMergeJoin [id" in plan(salted_join(a, b, ["id"], ["v"], hot=spark.createDataFrame([], "id long")))
    out = resolve.resolve(spark.range(1, 5).withColumnRenamed("id", "seq"), matches)
    assert "Broadcast" not in plan(out) and rows(out, "seq", "root") == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_sets_keep_no_whole_rows(spark):
    """Word sets are stored by columns; a checkpoint of whole rows took twice the disk."""
    from pathlib import Path

    from placewright.session import work_dir
    cut_lineage(spark.range(1))  # a folder is set
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p.name for p in folder.glob("**/rdd-*")}
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c"]), (3, ["x"])], "id long, w array<string>")
    assert before and rows(similarity.similar_sets(df, "id", "w", 0.8), "id_a", "id_b") == [(1, 2)]
    assert {p.name for p in folder.glob("**/rdd-*")} <= before and list(Path(work_dir(spark).removeprefix("file:")).glob("tables/*"))


def test_city_statistics_in_any_order(spark):
    """Ratings whose mean is a half of the last digit, in three orders: a sum of doubles falls on either side of it."""
    ratings = [(i * 37) % 50 / 10 for i in range(900)]
    for given in (ratings, sorted(ratings), sorted(ratings, reverse=True)):
        df = spark.createDataFrame([("a", ["x"], 1, r) for r in given] + [("b", ["x"], 1, float("nan")), ("b", ["x"], 1, 2.0), ("c", ["x"], 1, None)],
                                   "city string, tags array<string>, price int, rating double").coalesce(1)
        got = {r["city"]: r["mean_rating"] for r in reports.city_statistics(df, "tags", "price", "rating").where("kind = 'all'").collect()}
        assert got["a"] == 2.5 and math.isnan(got["b"]) and got["c"] is None
