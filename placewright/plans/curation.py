"""Quality columns, the curation run and geo enrichment as single plans."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import geo as G
from ..functions import scoring as S
from ..functions.text import let
from ..operators import resolve as R
from ..operators.skew import HOT_ROWS


def with_quality(df: DataFrame, min_completeness: float = rules.MIN_COMPLETENESS, require_photo: bool = True) -> DataFrame:
    """Five scores, overall score, level, acceptance, warnings and recommendations."""
    scores = F.struct(
        S.completeness(df.schema).alias("completeness"), F.round(S.photo_score("photos", "image_url"), 4).alias("photo"),
        S.freshness_score("last_updated").alias("freshness"), F.round(S.source_reliability("domain", "url"), 4).alias("reliability"),
        F.round(S.validation_score("name", "url", "geo_lat", "geo_lng", "address", "tags", "description"), 4).alias("validation"))
    names = ["completeness", "photo", "freshness", "reliability", "validation"]
    args = (min_completeness, require_photo)

    def rated(s: Column, overall: Column) -> Column:
        core = (s["completeness"], s["photo"], overall)
        return F.struct(*[s[n].alias(n) for n in names], overall.alias("overall"), S.quality_level(overall).alias("level"),
                        S.acceptable(*core, *args).alias("accepted"), S.warnings_of(*core, *args).alias("warnings"),
                        S.recommendations_of(s["completeness"], s["photo"], s["freshness"]).alias("recommendations"))
    # Bound once: seven nested aliases under a filter would make the optimizer's constraint sets explode.
    bound = let(scores, lambda s: let(S.overall_score(*[s[n] for n in names]), lambda o: rated(s, o)))
    return df.withColumn("_q", bound).select("*", "_q.*").drop("_q")


def curate(df: DataFrame, seq: str = "seq", hot_rows: int = HOT_ROWS, **matching) -> DataFrame:
    """Every row with a status: error (no name), duplicate (with strategy and kept row), rejected (with reasons) or new."""
    broken = F.coalesce(F.trim("name"), F.lit("")) == ""
    usable = df.where(~broken)
    matches = R.match_rows(usable, seq, hot_rows=hot_rows, **matching)
    resolved = R.resolve(df, matches, seq)
    scored = with_quality(resolved)
    status = F.when(broken, "error").when(F.col("is_duplicate"), "duplicate").when(~F.col("accepted"), "rejected").otherwise("new")
    return scored.withColumn("status", status)


def with_coordinates(df: DataFrame, lat: str = "geo_lat", lng: str = "geo_lng", name: str = "name", address: str = "address") -> DataFrame:
    """Missing coordinates from the district that name or address mentions, else the city's centre; ``geo_source`` tells which."""
    known = F.col(lat).isNotNull() & F.col(lng).isNotNull()
    near = G.centre_by_words(name, address)
    found = df.withColumn("_c", F.when(~known, near))
    return (found.withColumn("geo_source", F.when(known, "given").when(F.col("_c.district").isNotNull(), F.col("_c.district")).otherwise("centre"))
            .withColumn(lat, F.when(known, F.col(lat)).otherwise(F.col("_c.lat"))).withColumn(lng, F.when(known, F.col(lng)).otherwise(F.col("_c.lng"))).drop("_c"))


def enrich_geo(df: DataFrame, lat: str = "geo_lat", lng: str = "geo_lng", price: str = "price_level") -> DataFrame:
    """Distance from the centre, city and district marks, nearest district, price band; local rules only."""
    near = G.nearest_district(lat, lng)
    return (df.withColumn("distance_from_center", F.round(G.distance_from_center(lat, lng), 6)).withColumn("in_city", G.in_city_box(lat, lng))
            .withColumn("districts", F.when(F.col(lat).isNotNull() & F.col(lng).isNotNull(), G.districts_of(lat, lng)).otherwise(F.array().cast("array<string>")))
            .withColumn("nearest_district", F.when(F.col(lat).isNotNull() & F.col(lng).isNotNull(), near["name"]))
            .withColumn("is_valid_geo", F.col("in_city") & (F.size("districts") > 0)).withColumn("price_band", G.provider_price(price)))
