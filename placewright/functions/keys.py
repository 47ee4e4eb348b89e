"""Identity keys, content ids and index keys."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, match_address, match_name, normalize_text
from .urls import domain_of


def fixed(x: Column | str, digits: int = 3) -> Column:
    """Fixed decimals, so a key never depends on how doubles print. Ties are judged on the scaled number and go to the even digit."""
    return F.format_string(f"%.{digits}f", F.rint(col(x) * 10.0 ** digits) / 10.0 ** digits)


def event_identity(title: Column | str, start: Column | str, venue: Column | str) -> Column:
    day = F.coalesce(F.date_format(col(start), "yyyy-MM-dd"), F.lit(""))
    parts = F.concat_ws("|", F.lower(normalize_text(title)), day,
                        F.coalesce(normalize_text(venue), F.lit("")))
    return F.sha2(parts, 256)


def place_identity(name: Column | str, city: Column | str, url: Column | str,
                   lat: Column | str, lon: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(
        F.lower(F.concat(col(name), F.lit("-"), col(city))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    where = F.when(col(lat).isNotNull() & col(lon).isNotNull(),
                   F.concat(F.lit("::"), fixed(lat), F.lit("_"), fixed(lon)))
    return F.concat(slug, F.lit("::"), F.coalesce(domain_of(url), F.lit("")), F.coalesce(where, F.lit("")))


def place_key(name: Column | str, city: Column | str, source: Column | str, area: Column | str,
              lat: Column | str, lon: Column | str) -> Column:
    has_geo = (F.coalesce(col(lat), F.lit(0.0)) != 0) & (F.coalesce(col(lon), F.lit(0.0)) != 0)
    return F.concat_ws("_", F.lower(col(name)), col(city), col(source),
                       F.when(col(area) != "", F.lower(col(area))),
                       F.when(has_geo, fixed(lat)), F.when(has_geo, fixed(lon)))


def match_key(name: Column | str, city: Column | str, domain: Column | str,
              lat: Column | str, lng: Column | str) -> Column:
    def filled(c: Column) -> Column:
        return F.when(c != "", c)
    has_geo = col(lat).isNotNull() & col(lng).isNotNull()
    return F.md5(F.concat_ws("|", filled(match_name(name)), filled(F.lower(col(city))),
                             filled(F.lower(col(domain))),
                             F.when(has_geo, fixed(lat)), F.when(has_geo, fixed(lng))))


def address_hash(address: Column | str) -> Column:
    """Null when the address is missing."""
    return F.when(F.coalesce(col(address), F.lit("")) != "", F.md5(match_address(address)))


def short_md5(title: Column | str, url: Column | str) -> Column:
    return F.substring(F.md5(F.concat(col(title), F.lit(":"), col(url))), 1, 12)


def url_id(url: Column | str) -> Column:
    return F.substring(F.sha2(col(url), 256), 1, 16)


def flag_key(city, day, flag) -> Column:
    return F.concat(F.lit("v2:"), F.lower(col(city)), F.lit(":"), col(day).cast("string"),
                    F.lit(":flag:"), F.lower(col(flag)))


def index_key(city, day) -> Column:
    return F.concat(F.lit("v2:"), F.lower(col(city)), F.lit(":"), col(day).cast("string"), F.lit(":index"))


def query_key(city, flag, query, limit) -> Column:
    return F.concat_ws(":", F.lit("places"), F.lower(col(city)),
                       F.when(col(flag) != "", F.concat(F.lit("flag:"), col(flag))),
                       F.when(col(query) != "", F.concat(F.lit("query:"), F.substring(F.md5(col(query)), 1, 8))),
                       F.concat(F.lit("limit:"), col(limit).cast("string")))


def ids_etag(ids: Column | str, weak: bool = False) -> Column:
    """Order-independent tag of a bounded id array (one page, one chunk)."""
    ordered = F.array_join(F.array_sort(F.transform(col(ids), lambda i: i.cast("string"))), ",")
    body = F.when(F.size(col(ids)) > 0, F.md5(ordered)).otherwise(F.lit("empty"))
    return F.concat(F.lit('W/"' if weak else '"'), body, F.lit('"'))
