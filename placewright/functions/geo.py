"""Coordinate columns. Distances are in degrees."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import col


def clean_coordinate(x: Column | str, bound: float) -> Column:
    value = col(x).try_cast("double") if not isinstance(x, str) else F.col(x).try_cast("double")
    return F.when(value.between(-bound, bound), F.bround(value, 6))


def clean_latitude(x):
    return clean_coordinate(x, 90.0)


def clean_longitude(x):
    return clean_coordinate(x, 180.0)


def degree_distance(lat1, lng1, lat2, lng2) -> Column:
    dx, dy = col(lat1) - col(lat2), col(lng1) - col(lng2)
    return F.sqrt(dx * dx + dy * dy)


def distance_from_center(lat, lng, center=rules.CENTER) -> Column:
    return degree_distance(lat, lng, F.lit(center[0]), F.lit(center[1]))


def in_city_box(lat, lng, box=rules.CITY_BOX) -> Column:
    return F.coalesce(col(lat).between(box[0], box[1]) & col(lng).between(box[2], box[3]), F.lit(False))


def districts_of(lat, lng, districts=rules.DISTRICTS) -> Column:
    """Names of all districts whose circle holds the point, in list order."""
    return F.filter(F.array(*[F.when(degree_distance(lat, lng, F.lit(la), F.lit(ln)) <= r, F.lit(name))
                              for name, la, ln, r in districts]), lambda n: n.isNotNull())


def centre_by_words(name: Column | str, address: Column | str, districts=rules.DISTRICTS, center=rules.CENTER) -> Column:
    """Struct (lat, lng, district) of the first listed district that name or address mentions, else of the city's centre."""
    low_name, low_address = F.lower(F.coalesce(col(name), F.lit(""))), F.lower(F.coalesce(col(address), F.lit("")))

    def point(lat: float, lng: float, district: str | None) -> Column:
        return F.struct(F.lit(lat).alias("lat"), F.lit(lng).alias("lng"), F.lit(district).cast("string").alias("district"))
    found = F.when(F.lit(False), point(*center, None))
    for district, lat, lng, _ in districts:
        found = found.when(low_name.contains(district) | low_address.contains(district), point(lat, lng, district))
    return found.otherwise(point(*center, None))


def nearest_district(lat, lng, districts=rules.DISTRICTS) -> Column:
    """Struct (distance, place, name) of the nearest centre, the first in the list on ties."""
    return F.array_min(F.array(*[F.struct(degree_distance(lat, lng, F.lit(la), F.lit(ln)).alias("distance"), F.lit(i).alias("place"),
                                          F.lit(name).alias("name")) for i, (name, la, ln, _) in enumerate(districts)]))


def provider_price(level: Column | str) -> Column:
    table = F.create_map(*[F.lit(v) for pair in rules.PROVIDER_PRICE.items() for v in pair])
    return F.when(col(level).isNotNull(),
                  F.coalesce(F.try_element_at(table, col(level).cast("int")), F.lit(rules.PROVIDER_PRICE_OTHER)))


def clamp_price_level(x: Column | str, low: int = 0, high: int = 4) -> Column:
    level = col(x).cast("string").try_cast("double").try_cast("int")
    return F.when(level.isNotNull(), F.least(F.greatest(level, F.lit(low)), F.lit(high)))
