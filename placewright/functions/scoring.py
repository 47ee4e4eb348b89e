"""Quality, coolness and relevance scores as columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from .tagging import first_listed_value
from .text import col, contains_any



def present(name: str, dtype: T.DataType) -> Column:
    """Non-blank text, non-empty list, any number."""
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def presence(schema: T.StructType) -> dict[str, Column]:
    """Presence test per known field; a field the table lacks is absent."""
    known = {f.name: f.dataType for f in schema.fields}
    fields = rules.REQUIRED_FIELDS + rules.IMPORTANT_FIELDS + rules.OPTIONAL_FIELDS
    return {f: present(f, known[f]) if f in known else F.lit(False) for f in fields}


def _points(test: Column, value: float) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0.0))


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def completeness(schema: T.StructType) -> Column:
    has = presence(schema)
    parts = [_points(has[f], w) for f, w in rules.FIELD_WEIGHTS.items()]
    parts += [_points(has[f], rules.OPTIONAL_BONUS) for f in rules.OPTIONAL_FIELDS]
    return F.round(F.least(_sum(parts), F.lit(1.0)), 3)


def photo_score(photos, image_url) -> Column:
    """0 without any image; points for count, file type, size words, dimensions and alt text."""
    pics = F.coalesce(col(photos), F.array().cast("array<struct<url:string,width:int,height:int,alt_text:string>>"))
    image = F.lower(F.coalesce(col(image_url), F.lit("")))
    details = F.aggregate(pics, F.lit(0.0), lambda acc, p: acc + _points(
        (F.coalesce(p["width"], F.lit(0)) > 0) & (F.coalesce(p["height"], F.lit(0)) > 0), 0.05)
        + _points(F.coalesce(p["alt_text"], F.lit("")) != "", 0.05))
    score = F.lit(0.5) + _points(F.size(pics) > 1, 0.2) \
        + _points((image != "") & contains_any(image, rules.IMAGE_EXTENSIONS), 0.1) \
        + _points((image != "") & contains_any(image, rules.IMAGE_SIZE_WORDS), 0.1) + details
    return F.when((F.size(pics) == 0) & (image == ""), F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def freshness_score(last_updated, years=rules.FRESHNESS_YEARS) -> Column:
    text = F.coalesce(col(last_updated), F.lit(""))
    chain = F.when(text == "", F.lit(rules.FRESHNESS_UNKNOWN))
    for year, score in years:
        chain = chain.when(text.contains(year), F.lit(score))
    return chain.otherwise(F.lit(rules.FRESHNESS_OLD))


def source_reliability(domain, url, table=rules.SOURCE_RELIABILITY) -> Column:
    key = F.replace(F.lower(F.coalesce(col(domain), F.lit(""))), F.lit("www."), F.lit(""))
    lookup = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    base = F.coalesce(F.try_element_at(lookup, key), F.lit(0.5))
    bonus = _points(F.coalesce(col(url), F.lit("")).startswith("https://"), 0.05)
    return F.when(F.coalesce(col(domain), F.lit("")) == "", F.lit(0.5)).otherwise(F.least(base + bonus, F.lit(1.0)))


def valid_url(url) -> Column:
    return F.coalesce(col(url).rlike(rules.URL_PATTERN), F.lit(False))


def validation_score(name, url, lat, lng, address, tags, description) -> Column:
    def longer(c, n):
        return F.coalesce(F.length(F.trim(col(c))) > n, F.lit(False))
    geo = F.coalesce(col(lat).between(-90, 90) & col(lng).between(-180, 180), F.lit(False))
    parts = [_points(longer(name, 0), 0.2),
             _points(longer(name, 0) & (F.length(col(name)) > 5), 0.1),
             _points(valid_url(url), 0.2), _points(geo, 0.2), _points(longer(address, 10), 0.1),
             _points(F.coalesce(F.size(col(tags)) > 0, F.lit(False)), 0.1), _points(longer(description, 20), 0.1)]
    return F.least(_sum(parts), F.lit(1.0))


def overall_score(completeness_, photo, freshness, reliability, validation) -> Column:
    w = rules.OVERALL_WEIGHTS
    return F.round(col(completeness_) * w["completeness"] + col(photo) * w["photo"] + col(freshness) * w["freshness"]
                   + col(reliability) * w["reliability"] + col(validation) * w["validation"], 3)


def quality_level(overall) -> Column:
    chain = None
    for floor, name in rules.QUALITY_LEVELS:
        test = col(overall) >= floor
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise("unacceptable")


def acceptable(completeness_, photo, overall, min_completeness=rules.MIN_COMPLETENESS, require_photo=True) -> Column:
    ok = (col(completeness_) >= min_completeness) & (col(overall) >= rules.MIN_OVERALL)
    return ok & (col(photo) > 0) if require_photo else ok


def warnings_of(completeness_, photo, overall, min_completeness=rules.MIN_COMPLETENESS, require_photo=True) -> Column:
    low = col(completeness_) < min_completeness
    return F.array_compact(F.array(
        F.when(low, F.format_string(f"Completeness below threshold (%.3f < {min_completeness})", col(completeness_))),
        F.when(F.lit(require_photo) & (col(photo) == 0), F.lit("Photo required but not provided")),
        F.when(col(overall) < rules.MIN_OVERALL, F.lit("Overall quality below acceptable threshold"))))


def recommendations_of(completeness_, photo, freshness) -> Column:
    return F.array_compact(F.array(
        F.when(col(completeness_) < 0.8, F.lit("Improve data completeness")),
        F.when(col(photo) == 0, F.lit("Add photos")).when(col(photo) < 0.5, F.lit("Improve photo quality")),
        F.when(col(freshness) < 0.7, F.lit("Update data freshness"))))


def recipe_score(schema: T.StructType, points: dict[str, int] = rules.RECIPE_POINTS, old_divisor: bool = False) -> Column:
    """Sum of points of filled fields over the sum of all points.

    ``old_divisor`` leaves the name out of the divisor and adds the minimum score .6 to it.
    """
    known = {f.name: f.dataType for f in schema.fields}
    parts = [_points(present(f, known[f]) if f in known else F.lit(False), float(v)) for f, v in points.items()]
    divisor = sum(points.values()) if not old_divisor else sum(v for f, v in points.items() if f != "name") + 0.6
    return F.least(_sum(parts) / F.lit(float(divisor)), F.lit(1.0))


# ---- coolness -----------------------------------------------------------------------------------

def popularity_score(popularity) -> Column:
    top = rules.POPULARITY_TOP
    value = F.least(F.greatest(col(popularity).cast("double"), F.lit(0.0)), F.lit(float(top)))
    return F.coalesce(F.log1p(value) / F.log1p(F.lit(float(top))), F.lit(0.0))


def price_score(price) -> Column:
    p = col(price).cast("double")
    return (F.when(p.isNull(), F.lit(0.5)).when(p == 0, F.lit(1.0))
            .otherwise(1 - F.least(F.greatest(p, F.lit(0.0)), F.lit(rules.PRICE_TOP)) / rules.PRICE_TOP))


def coolness(source, popularity, price, time_text, category, venue, title, description, day, as_of,
             digits: int = 4) -> Column:
    evening = contains_any(F.lower(F.coalesce(col(time_text), F.lit(""))), rules.NIGHT_TIMES) \
        | contains_any(F.lower(F.coalesce(col(category), F.lit(""))), rules.NIGHT_CATEGORIES)
    text = F.lower(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), col(description)))
    w = rules.COOLNESS_WEIGHTS
    parts = [
        w["source"] * first_listed_value(source, rules.SOURCE_WEIGHTS, 0.4, 0.3),
        w["popularity"] * popularity_score(popularity),
        w["price"] * price_score(price),
        w["time_slot"] * F.when(evening, F.lit(0.7)).otherwise(F.lit(0.5)),
        w["venue"] * first_listed_value(venue, rules.VENUE_RANKS, 0.5, 0.4),
        w["text"] * F.when(contains_any(text, rules.TEXT_BONUS), F.lit(1.0)).otherwise(F.lit(0.5)),
        w["fresh"] * F.when(col(day) == col(as_of), F.lit(1.0)).otherwise(F.lit(0.5)),
    ]
    return F.round(_sum(parts), digits)


def boosted(score, title, description, venue, tags, digits: int = 4) -> Column:
    text = F.lower(F.concat(F.coalesce(col(title), F.lit("")), F.coalesce(col(description), F.lit(""))))
    tag_text = F.lower(F.array_join(F.coalesce(col(tags), F.array().cast("array<string>")), " "))
    parts = [F.coalesce(col(score), F.lit(0.0)),
             _points(contains_any(text, rules.BOOST_TEXT), 0.3),
             _points(contains_any(F.lower(F.coalesce(col(venue), F.lit(""))), rules.BOOST_VENUES), 0.2),
             _points(tag_text.contains("picks"), 0.5), _points(tag_text.contains("hot"), 0.3)]
    return F.round(_sum(parts), digits)


def simple_coolness(popularity, rating, image, venue) -> Column:
    pop, rate = F.coalesce(col(popularity), F.lit(0)), F.coalesce(col(rating), F.lit(0))
    return pop * 0.5 + rate * 0.3 + _points(F.coalesce(col(image), F.lit("")) != "", 0.2) \
        + _points(F.coalesce(col(venue), F.lit("")) != "", 0.1)


def simple_boost(popularity, rating, image, venue) -> Column:
    pop, rate = F.coalesce(col(popularity), F.lit(0)), F.coalesce(col(rating), F.lit(0))
    factor = F.lit(1.0) + _points(pop > 7, 0.2) + _points(rate > 4.5, 0.1)
    return simple_coolness(popularity, rating, image, venue) * factor


# ---- query relevance ------------------------------------------------------------------------------

def query_relevance(query: str, name, description, tags, flags, skip_topics: tuple[str, ...] = ()) -> Column:
    """Points of one free-text query for each row: the query is a constant, so its rules fold away."""
    low = query.lower()
    words = low.split()
    empty = F.array().cast("array<string>")
    tag_list, flag_list = F.coalesce(col(tags), empty), F.coalesce(col(flags), empty)

    def hits(values: Column, points: float) -> Column:
        return F.size(F.filter(values, lambda v: contains_any(F.lower(v), words))) * F.lit(points)

    if not words:
        return F.lit(0.0)
    parts = [_points(contains_any(F.lower(col(name)), words), 10.0),
             _points(contains_any(F.lower(col(description)), words), 5.0), hits(tag_list, 8.0), hits(flag_list, 6.0)]
    for triggers, want_flags, want_tags in rules.QUERY_RULES:
        if any(t in low for t in triggers) and not set(triggers) & set(skip_topics):
            parts.append(_points(F.arrays_overlap(flag_list, F.array(*[F.lit(f) for f in want_flags])), 15.0))
            parts.append(_points(F.arrays_overlap(tag_list, F.array(*[F.lit(t) for t in want_tags])), 10.0))
    return _sum(parts)
