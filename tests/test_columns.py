"""Text, key, date, tag and score columns on small fixtures."""
import datetime as dt

from pyspark.sql import functions as F

from placewright import rules
from placewright.functions import dates as D
from placewright.functions import geo as G
from placewright.functions import html as H
from placewright.functions import keys as K
from placewright.functions import scoring as SC
from placewright.functions import tagging as TG
from placewright.functions import text as X
from placewright.functions import urls as U
from placewright.operators import normalize as N


def one(spark, *cols, data="x"):
    return spark.createDataFrame([(data,)], "x string").select(*cols).first()


def test_normalize_text(spark):
    r = one(spark, X.normalize_text("x"), X.norm_tag("x"), data="  Title &amp; More&#33;&#x1F600;  a  b &amp;lt; ")
    assert r[0] == "Title & More!\U0001F600 a b &lt;" and r[1].startswith("title & more")
    assert one(spark, X.normalize_text("x"), data="&frac12; &amp;")[0] == "½ &"


def test_truncate(spark):
    assert one(spark, X.safe_truncate("x", 8), data="hello brave world")[0] == "hello…"
    assert one(spark, X.safe_truncate("x", 50), data="short")[0] == "short"
    assert one(spark, X.safe_truncate("x", 4), data="unbroken")[0] == "unbr…"
    short, full = X.long_description("x", 8)
    assert tuple(one(spark, short, full, data="hello brave world")) == ("hello…", "hello brave world")


def test_lists_and_values(spark):
    df = spark.createDataFrame([([" Food ", "music", "FOOD", ""],)], "t array<string>")
    assert df.select(X.unique_list("t")).first()[0] == ["food", "music"]
    vals = {"yes": True, "1": True, "false": False, "0": False, "No": False, "2.5": True, "0.0": False, "maybe": True, "": False}
    for v, want in vals.items():
        assert one(spark, X.loose_bool("x"), data=v)[0] is want, v
    assert one(spark, X.parse_number("x"), data="12,5")[0] == 12.5
    assert one(spark, X.parse_number("x"), data="abc")[0] is None


def test_urls(spark):
    cases = {"//host/x": "https://host/x", "host.com/y": "https://host.com/y", "mailto:a@b": "mailto:a@b", "http://a.b": "http://a.b"}
    for v, want in cases.items():
        assert one(spark, U.normalize_url("x"), data=v)[0] == want
    base = F.lit("https://s.com/a/page.html")
    assert one(spark, U.absolute_url("x", base), data="i.png")[0] == "https://s.com/a/i.png"
    assert one(spark, U.absolute_url("x", base), data="/i.png")[0] == "https://s.com/i.png"
    assert one(spark, U.domain_of("x"), data="https://WWW.Ab.com:80/x?y")[0] == "www.ab.com:80"


def test_names_and_keys(spark):
    assert one(spark, X.match_name("x"), data="The Best  Blue Bar Restaurant")[0] == "blue"  # both suffixes, in list order
    assert one(spark, X.match_address("x"), data="12 Silom Road, Bangkok")[0] == "12 silom"
    r = one(spark, K.place_identity(F.lit("Blue Bar!"), F.lit("Bangkok"), F.lit("https://a.com/x"), F.lit(13.7564), F.lit(100.5)))
    assert r[0] == "blue-bar-bangkok::a.com::13.756_100.500"
    assert one(spark, K.ids_etag(F.array(F.lit("b"), F.lit("a"))))[0] == one(spark, K.ids_etag(F.array(F.lit("a"), F.lit("b"))))[0]
    assert one(spark, K.ids_etag(F.array().cast("array<string>")))[0] == '"empty"'
    assert one(spark, K.ids_etag(F.array(F.lit("a")), weak=True))[0].startswith('W/"')


def test_title_case_and_cleaning(spark):
    assert one(spark, X.title_case("x"), data="the house OF the rising sun")[0] == "The House of The Rising Sun"
    assert one(spark, X.expand_abbreviations("x"), data="5 Main st. and 2nd Ave")[0] == "5 Main Street and 2nd Avenue"
    assert one(spark, N.clean_title("x"), data="<b>blue</b>  lotus")[0] == "Blue Lotus"
    assert one(spark, X.single_tag("x"), data=" Live Music! ")[0] == "live-music"
    assert one(spark, X.trim_bullets("x"), data="★ Name •")[0] == "Name"
    assert one(spark, X.remove_patterns("x", rules.DESCRIPTION_CLEANUP), data="An amazing place for lunch")[0] == "An for lunch"


def test_stems(spark):
    for w, want in {"parties": "party", "boxes": "box", "cats": "cat", "class": "class", "s": "s"}.items():
        assert one(spark, X.stem_en("x"), data=w)[0] == want


def test_dates(spark):
    as_of = F.lit(dt.date(2025, 1, 15))
    for v, want in {"12 Jan 2025": dt.date(2025, 1, 12), "Jan 12, 2025": dt.date(2025, 1, 12), "on 2025-02-03": dt.date(2025, 2, 3), "7 Mar": dt.date(2025, 3, 7),
                    "March 9": dt.date(2025, 3, 9), "31 Feb 2025": None, "soon": None}.items():
        assert one(spark, D.parse_absolute("x", as_of), data=v)[0] == want, v
    for v, (s, e) in {"4–6 Jan": (dt.date(2025, 1, 4), dt.date(2025, 1, 6)), "Jan 4-6": (dt.date(2025, 1, 4), dt.date(2025, 1, 6)), "until end of month": (dt.date(2025, 1, 15), dt.date(2025, 1, 31)),
                      "every friday": (dt.date(2025, 1, 17), dt.date(2025, 1, 17))}.items():
        assert tuple(one(spark, D.parse_day_range("x", as_of), data=v)[0]) == (s, e), v
    assert tuple(one(spark, D.parse_day_range("x", F.lit(dt.date(2025, 1, 17))), data="every friday")[0])[0] == dt.date(2025, 1, 17)
    assert tuple(one(spark, D.parse_dash_range("x", as_of), data="6 Sep — 7 Dec 2025")[0]) == (dt.date(2025, 9, 6), dt.date(2025, 12, 7))
    assert tuple(one(spark, D.parse_dash_range("x", as_of), data="13—25 Aug 2025")[0]) == (dt.date(2025, 8, 13), dt.date(2025, 8, 25))
    assert one(spark, D.local_day(F.lit("2025-08-31T22:30:00Z").cast("timestamp")))[0] == dt.date(2025, 9, 1)


def test_tags(spark):
    def score(query, tags, attrs=None):
        df = spark.createDataFrame([(query, tags, attrs)], "q string, t array<string>, a map<string,boolean>")
        return df.select(TG.tag_match_score("q", "t", "a")).first()[0]
    assert score("music", ["live music"]) >= 1
    assert score("art", ["party"]) == 0
    assert score("markets", ["market"]) >= 1 and score("markets", ["ตลาด"]) == 2
    assert score("rooftop", ["bar"], {"rooftop": True}) == 2 and score("outdoor", [], {"outdoor": True}) == 2
    assert score("jazz", ["jazz"]) == 2


def test_flags_and_attributes(spark):
    df = spark.createDataFrame([("Jazz night", "at the skybar", ["x"]), ("Party", None, None), ("ART Show", "", [])], "t string, d string, g array<string>")
    got = [r[0] for r in df.select(TG.keyword_flags("t", "d", "g")).collect()]
    assert got == [["jazz_blues", "rooftop"], [], ["art_exhibits"]]
    a = one(spark, TG.text_attributes("x", F.lit(None).cast("string")), data="Street Food Market")[0]
    assert a["streetfood"] and a["market"] and not a["rooftop"]
    assert one(spark, TG.text_attributes("x", F.lit("")), data="Party time")[0]["art"] is True
    assert one(spark, TG.enriched_tags(F.array(F.lit(" A "), F.lit("a")), F.array(F.lit("Editor's Pick"), F.lit("zzz"))))[0] == ["a", "editors_pick"]
    assert one(spark, TG.cascade_flags("x"), data="quiet hill")[0] == ["attractions"]


def test_scores(spark):
    assert one(spark, SC.freshness_score("x"), data="2023-01-01")[0] == 0.7
    assert round(one(spark, SC.source_reliability(F.lit("www.timeout.com"), F.lit("https://x")))[0], 6) == 0.95
    assert one(spark, SC.valid_url("x"), data="https://a.com/x")[0] and not one(spark, SC.valid_url("x"), data="ftp://a")[0]
    assert round(one(spark, SC.popularity_score(F.lit(500)))[0], 6) == 1.0
    assert one(spark, SC.price_score(F.lit(None).cast("double")))[0] == 0.5 and one(spark, SC.price_score(F.lit(600.0)))[0] == 0.5
    assert one(spark, G.clamp_price_level("x"), data="9")[0] == 4 and one(spark, G.clamp_price_level("x"), data="a")[0] is None
    assert one(spark, G.clean_longitude(F.lit(100.1234567)))[0] == 100.123457 and one(spark, G.clean_latitude(F.lit(91.0)))[0] is None


def test_html(spark):
    page = '<meta property="og:image" content="/a.png"><img src="/b.png"><script type="application/ld+json">{"latitude": 1.5, "longitude": 2.5}</script><!-- <p>no</p> --><p>Yes</p>'
    assert one(spark, H.choose_image("x"), data=page)[0] == "/a.png"
    assert one(spark, H.best_image("x", F.lit("https://s.com/p")), data=page)[0] == "https://s.com/a.png"
    assert tuple(one(spark, H.coordinates("x"), data=page)[0]) == (1.5, 2.5)
    assert one(spark, H.visible_text("x"), data=page)[0] == "Yes"
    assert one(spark, H.choose_image("x", F.lit("ld.png")), data='<img src="b">')[0] == "ld.png"


def test_every_reference(spark):
    """All references of the standard, and none that makes it fail, against the standard library."""
    import html
    import random
    rng, names = random.Random(1), list(html.entities.html5)
    told = ["&#9999999;", "&#8217", "&#150;", "&#129;", "&#xD800;", "&#0;", "&#99999999999999999999999;", "&notit;", "&amp;lt;", "&;", "&#;", "a & b", "&ampamp", ""]
    told += ["".join(rng.choice(["&" + rng.choice(names), "&" + rng.choice(names)[:-1], "x", ";", " ", "&#%d;" % rng.randrange(70000),
                                 "&#x%x" % rng.randrange(0x120000), "é", "<"]) for _ in range(4)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in told], "t string")
    assert all(r.u == html.unescape(r.t) for r in df.select("t", X.unescape("t").alias("u")).collect())


def test_list_places(spark):
    html = "<ul><li>1. Blue Door by the river bank</li><li>– <b>Old Hall</b>, open every day</li><li>short</li><li>12. - x and more text here</li></ul>"
    got = one(spark, H.list_places("x"), data=html)[0]
    assert [(p["name"], p["description"]) for p in got] == [("Blue Door by the river bank", "1. Blue Door by the river bank"),
                                                           ("Old Hall, open every day", "– Old Hall, open every day"), ("x and more text here", "12. - x and more text here")]


def test_fixed_ties(spark):
    """A coordinate a last bit off a tie counts as the tie."""
    assert [one(spark, K.fixed(F.lit(v)))[0] for v in (13.5005, 13.836500000000001, 100.74549999999999, 13.5534)] == ["13.500", "13.836", "100.746", "13.553"]


def test_nearest_district_ties(spark):
    assert one(spark, G.nearest_district(F.lit(13.5), F.lit(100.0), [("late", 13.0, 100.0, 1.0), ("early", 14.0, 100.0, 1.0)])["name"])[0] == "late"


def test_closed_references(spark):
    assert one(spark, X.unescape("x", closed=True), data="a&ampb &amp;lt; &#65 &#65; &x; &eacute;&lt &")[0] == "a&ampb &lt; &#65 A &x; é&lt &"


def test_closed_references_of_pages(spark):
    page = "<title>R&ampD &amp; Co</title><h1>it&amp</h1>"
    assert tuple(one(spark, H.title_of("x", closed=True), H.first_heading("x", closed=True), H.visible_text("x", closed=True), data=page)) == ("R&ampD & Co", "it&amp", "R&ampD & Coit&amp")
    assert one(spark, H.visible_text("x"), data=page)[0] == "R&D & Coit&"


def test_prices_are_whole_words(spark):
    page = "<p>call 216 thblehe, 9 goingly</p><h3>Hall 5</h3><span>1,250 THB</span><p>Rated; 12 interested</p>next"
    assert tuple(one(spark, H.min_price("x"), H.popularity_number(H.spaced_text("x")), data=page)) == (1250.0, 12)
