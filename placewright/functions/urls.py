"""URL columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, normalize_text


def normalize_url(x: Column | str) -> Column:
    """``//host`` and bare hosts get https; a given scheme is kept."""
    value = normalize_text(x)
    return (F.when(value == "", value)
            .when(value.startswith("//"), F.concat(F.lit("https:"), value))
            .when(~value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"),
                  F.concat(F.lit("https://"), F.regexp_replace(value, "^/+", "")))
            .otherwise(value))


def domain_of(x: Column | str) -> Column:
    """Host with port, lower case, no user part."""
    host = F.regexp_extract(col(x), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.when(host != "", F.lower(host))


def origin_of(x: Column | str) -> Column:
    return F.regexp_extract(col(x), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def absolute_url(x: Column | str, base: Column | str) -> Column:
    """Relative image address against the page address."""
    value, page = col(x), F.coalesce(col(base), F.lit(""))
    folder = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(folder, r"/[^/]*\.[^/]*$", ""), "/+$", "")
    return (F.when(F.coalesce(value, F.lit("")) == "", F.lit(""))
            .when(value.rlike("^https?://"), value)
            .when(value.startswith("//"), F.concat(F.lit("https:"), value))
            .when(page == "", value)
            .when(value.startswith("/"), F.concat(origin_of(page), value))
            .otherwise(F.concat(origin_of(page), folder, F.lit("/"), value)))


def maps_search_url(name: Column | str, address: Column | str, lat: Column | str, lng: Column | str,
                    place: str = "Bangkok, Thailand") -> Column:
    text = F.concat_ws(" ", col(name), F.when(col(address) != "", col(address)), F.lit(place))
    query = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    ll = F.when((col(lat) != 0) & (col(lng) != 0),
                F.concat(F.lit("&ll="), col(lat).cast("string"), F.lit(","), col(lng).cast("string")))
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), query,
                    F.coalesce(ll, F.lit("")))
