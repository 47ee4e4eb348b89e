"""Columns over raw page text, with regular expressions the JVM runs inside one stage."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import alternation, col, collapse_spaces, strip, unescape
from .urls import absolute_url


def group(text, pattern: str, i: int = 1) -> Column:
    value = F.regexp_extract(col(text), pattern, i)
    return F.when(value != "", value)


def meta_content(html, key: str, attribute: str = "property") -> Column:
    """``content`` of a meta tag, attributes in either order, single or double quotes."""
    k = re.escape(key)
    a = rf"""(?is)<meta\b[^>]*\b{attribute}\s*=\s*["']{k}["'][^>]*\bcontent\s*=\s*("[^"]*"|'[^']*')"""
    b = rf"""(?is)<meta\b[^>]*\bcontent\s*=\s*("[^"]*"|'[^']*')[^>]*\b{attribute}\s*=\s*["']{k}["']"""
    # most pages lack most keys: a plain search spares them the patterns
    there = F.lower(col(html)).contains(key.lower())
    return unescape(F.when(there, F.coalesce(_unquoted(group(html, a, 1)), _unquoted(group(html, b, 1)))))


def _unquoted(quoted: Column) -> Column:
    """Without its quotes; null where nothing is between them."""
    return F.nullif(F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit(""))


def open_graph(html, url) -> Column:
    return F.struct(meta_content(html, "og:title").alias("name"),
                    meta_content(html, "og:description").alias("description"),
                    meta_content(html, "og:image").alias("image_url"),
                    F.coalesce(meta_content(html, "og:url"), col(url)).alias("url"))


def json_ld_blocks(html) -> Column:
    """Array of script bodies of type application/ld+json."""
    return F.regexp_extract_all(col(html), F.lit(
        r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def _without_tags(html, between: str, closed: bool) -> Column:
    without = F.regexp_replace(F.regexp_replace(col(html), r"(?is)<!--.*?-->", ""),
                               r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return strip(collapse_spaces(unescape(F.regexp_replace(without, r"<[^>]+>", between), closed)))


def visible_text(html, closed: bool = False) -> Column:
    """Text outside tags, comments, scripts and styles; ``closed`` leaves references without ``;`` as they stand."""
    return _without_tags(html, "", closed)


def spaced_text(html) -> Column:
    """The same with a blank for each tag, so that words of different elements stay apart."""
    return _without_tags(html, " ", False)


def title_of(html, closed: bool = False) -> Column:
    return strip(collapse_spaces(unescape(group(html, r"(?is)<title\b[^>]*>(.*?)</title>"), closed)))


def first_heading(html, closed: bool = False) -> Column:
    return strip(collapse_spaces(unescape(F.regexp_replace(group(html, r"(?is)<h1\b[^>]*>(.*?)</h1>"), r"<[^>]+>", ""), closed)))


def count_of(html, pattern: str) -> Column:
    return F.regexp_count(col(html), F.lit("(?i)" + pattern))


def page_counts(html) -> dict[str, Column]:
    return {
        "n_links": count_of(html, r"<a\b"), "n_images": count_of(html, r"<img\b"),
        "n_lists": count_of(html, r"<(?:ul|ol)\b"), "n_list_items": count_of(html, r"<li\b"),
        "n_headings": count_of(html, r"<h[1-6]\b"), "n_paragraphs": count_of(html, r"<p\b"),
        "n_tables": count_of(html, r"<table\b"), "n_forms": count_of(html, r"<form\b"),
        "n_json_ld": count_of(html, r"application/ld\+json"), "n_open_graph": count_of(html, r"""property=["']og:"""),
    }


def first_image(html) -> Column:
    return group(html, r"""(?is)<img\b[^>]*\bsrc\s*=\s*["']([^"']+)["']""")


def choose_image(html, json_ld_image=None) -> Column:
    """Open Graph, then JSON-LD, then the first img."""
    parts = [meta_content(html, "og:image")]
    if json_ld_image is not None:
        parts.append(F.when(col(json_ld_image) != "", col(json_ld_image)))
    return F.coalesce(*parts, first_image(html))


def best_image(html, base) -> Column:
    """Open Graph, twitter card, first img; only absolute or root-relative addresses, made absolute."""
    def usable(c: Column) -> Column:
        return F.when(c.startswith("http") | c.startswith("/"), absolute_url(c, base))
    return F.coalesce(usable(meta_content(html, "og:image")), usable(meta_content(html, "twitter:image", "name")),
                      usable(first_image(html)))


def coordinates(html) -> Column:
    """(lat, lng) of the first JSON-LD block that has both, else the geo.position meta tag."""
    def pair(block: Column) -> Column:
        def pick(*paths):
            return F.coalesce(*[F.get_json_object(block, p) for p in paths]).try_cast("double")
        return F.struct(pick("$.latitude", "$.lat", "$.geo.latitude").alias("lat"),
                        pick("$.longitude", "$.lng", "$.lon", "$.geo.longitude").alias("lng"))
    pairs = F.filter(F.transform(json_ld_blocks(html), pair), lambda p: p["lat"].isNotNull() & p["lng"].isNotNull())
    meta = F.split(meta_content(html, "geo.position", "name"), ";")
    from_meta = F.when(F.size(meta) == 2, F.struct(F.trim(meta[0]).try_cast("double").alias("lat"),
                                                   F.trim(meta[1]).try_cast("double").alias("lng")))
    return F.coalesce(F.get(pairs, 0), from_meta)


def min_price(html, json_ld=None) -> Column:
    """Offer price, zero for free, else the first ``N THB``."""
    text = spaced_text(html)
    thb = F.replace(group(text, rules.PAGE_PRICE), F.lit(","), F.lit("")).try_cast("double")
    free = F.when(text.rlike(rules.PAGE_FREE), F.lit(0.0))
    parts = [free, thb]
    if json_ld is not None:
        parts.insert(0, F.coalesce(F.get_json_object(col(json_ld), "$.offers.price"),
                                   F.get_json_object(col(json_ld), "$.offers[0].price")).try_cast("double"))
    return F.coalesce(*parts)


def popularity_number(text) -> Column:
    return F.replace(group(text, rules.PAGE_POPULARITY),
                     F.lit(","), F.lit("")).try_cast("int")


def contact_block(text) -> dict[str, Column]:
    """Rating, reviews, hours, phone, website, category, features, busy hours and address by pattern."""
    t = col(text)
    dollars = F.length(group(t, rules.CONTACT_DOLLARS))
    return {
        "rating": F.coalesce(*[group(t, p) for p in rules.CONTACT_RATING]).try_cast("double"),
        "reviews_count": F.replace(group(t, rules.CONTACT_REVIEWS), F.lit(","), F.lit("")).try_cast("int"),
        "price_signs": dollars,
        "opening_hours": F.when(
            group(t, rules.CONTACT_OPEN_SPAN).isNotNull(),
            F.concat(group(t, rules.CONTACT_OPENS), F.lit(" - "),
                     group(t, rules.CONTACT_CLOSES))),
        "phone": group(t, rules.CONTACT_PHONE),
        "website": group(t, rules.CONTACT_WEBSITE),
        "category": F.lower(group(t, rules.CONTACT_CATEGORY)),
        "features": F.array_compact(F.array(*[F.when(t.rlike(f"(?i){re.escape(w)}"), F.lit(w)) for w in rules.FEATURE_WORDS])),
        "popular_hours": F.trim(group(t, rules.CONTACT_POPULAR_HOURS)),
        "scraped_address": F.trim(group(t, rules.CONTACT_ADDRESS)),
    }


def prose_place_name(text) -> Column:
    """Capitalised name before a kind word; three patterns, first hit."""
    return F.coalesce(*[group(text, f"({rules.PROSE_NAME_START}(?:{ends}))") for ends in rules.PROSE_NAME_ENDINGS])


def looks_like_place_name(text) -> Column:
    return F.coalesce(F.length(col(text)).between(3, 100) & F.lower(col(text)).rlike(alternation(rules.PLACE_NAME_WORDS)), F.lit(False))


def contains_place_info(text) -> Column:
    return F.coalesce((F.length(col(text)) >= 50) & F.lower(col(text)).rlike(alternation(rules.PLACE_INFO_WORDS)), F.lit(False))


def sitemap_urls(xml) -> Column:
    return F.transform(F.regexp_extract_all(col(xml), F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1)),
                       lambda u: unescape(F.trim(u)))


def list_items(html) -> Column:
    """Inner text of every li, tags removed."""
    return F.transform(F.regexp_extract_all(col(html), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)),
                       lambda i: strip(collapse_spaces(unescape(F.regexp_replace(i, r"<[^>]+>", "")))))


def list_places(html, least: int = 20) -> Column:
    """(name, description) of each list item of ``least`` characters: the name without number and dash, at least 3 long."""
    def parts(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, r"^[0-9]+\.\s*", ""), r"^\s*[-–—]\s*", "")
        return F.struct(bare.alias("name"), text.alias("description"))
    long = F.filter(list_items(html), lambda i: F.length(i) >= least)
    return F.filter(F.transform(long, parts), lambda p: F.length(p["name"]) >= 3)
