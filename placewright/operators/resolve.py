"""Entity resolution: identity, fuzzy name, address and nearest-point matches against earlier rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import keys as K
from ..functions.text import match_address, match_name
from ..session import cut_lineage, written
from .graph import components
from .similarity import similar_texts
from .skew import HOT_ROWS, measured_join, salted_join, whole


def with_match_columns(df: DataFrame) -> DataFrame:
    return (df.withColumn("match_name", match_name("name"))
            .withColumn("match_key", K.match_key("name", "city", "domain", "geo_lat", "geo_lng"))
            .withColumn("match_address", match_address("address"))
            .withColumn("address_hash", K.address_hash("address")))


def earliest_with_key(df: DataFrame, key: str, seq: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(seq, match) linking each later row to the earliest row with an equal, non-empty key."""
    rows = df.where(F.coalesce(F.col(key), F.lit("")) != "").select(seq, F.col(key).alias("_key"))
    firsts = rows.groupBy("_key").agg(F.min(seq).alias("match"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return salted_join(rows, firsts, ["_key"], [seq], "inner", hot_rows).where(F.col("match") < F.col(seq)).select(seq, "match")


def best_earlier_name(df: DataFrame, ratio: float, block: list[str], seq: str = "seq", metric: str = "levenshtein",
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """(seq, match, score): the most similar earlier name, the earliest on ties.

    With ``block=[]`` names are compared across all rows; a block such as city keeps equal names of
    different cities apart.
    """
    pairs = similar_texts(df, seq, "match_name", ratio, block, metric, True, hot_rows)
    best = F.max_by(F.col("id_a"), F.struct(F.col("score"), -F.col("id_a")))
    return pairs.groupBy(F.col("id_b").alias(seq)).agg(best.alias("match"), F.max("score").alias("score"))


def nearest_within(df: DataFrame, x: str, y: str, tolerance: float, seq: str = "seq", levels: int = 5, shrink: int = 4,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """(seq, match, distance): nearest earlier row within the tolerance, the earliest on ties.

    Equal points are one node. The search runs from a fine grid to the full tolerance: a row that found a
    neighbour at a fine level is not asked again, and rows still asking at a coarser level lie apart from each
    other, so a crowded cell never meets itself. A level is a quarter of the next, so that those still asking have few points
    within reach however dense all lie.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(seq, F.col(x).alias("_x"), F.col(y).alias("_y"))
    nodes = cut_lineage(rows.groupBy("_x", "_y").agg(F.min(seq).alias("_id"), F.count(F.lit(1)).alias("_copies")))
    same = salted_join(rows, nodes.where("_copies > 1").drop("_copies"), ["_x", "_y"], [seq], "inner", hot_rows) \
        .where(F.col("_id") < F.col(seq)).select(seq, F.col("_id").alias("match"), F.lit(0.0).alias("distance"))
    points = nodes.select("_id", "_x", "_y")
    asking, out = points, same
    for level in reversed(range(levels)):
        size = tolerance / shrink ** level
        reach = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        held = points.select(F.col("_id").alias("p"), F.col("_x").alias("px"), F.col("_y").alias("py"),
                             F.floor(F.col("_x") / size).alias("cx"), F.floor(F.col("_y") / size).alias("cy"))
        asked = (asking.withColumn("dx", reach).withColumn("dy", reach)
                 .select("_id", "_x", "_y", (F.floor(F.col("_x") / size) + F.col("dx")).alias("cx"),
                         (F.floor(F.col("_y") / size) + F.col("dy")).alias("cy")))
        dx, dy = F.col("_x") - F.col("px"), F.col("_y") - F.col("py")
        near = (measured_join(held, asked, ["cx", "cy"], ["p"], "inner", hot_rows).where(F.col("p") < F.col("_id"))
                .withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= size)
                .groupBy("_id").agg(F.min(F.struct("d", "p")).alias("m")))
        near = written(near)  # read by the result and by who still asks
        out = out.unionByName(near.select(F.col("_id").alias(seq), F.col("m.p").alias("match"), F.col("m.d").alias("distance")))
        if level:
            asking = written(asking.join(whole(near.select("_id")), "_id", "left_anti"))
    return out


STRATEGIES = ["identity", "fuzzy", "address", "geo"]


def match_parts(base: DataFrame, seq: str, name_ratio: float, tolerance: float, block: list[str], metric: str = "levenshtein", hot_rows: int = HOT_ROWS) -> list[DataFrame]:
    """(seq, match, score) of each strategy in their order; of a nearest point the score is its distance below zero."""
    whole = F.lit(1.0).alias("score")
    return [earliest_with_key(base, "match_key", seq, hot_rows).select(seq, "match", whole),
            best_earlier_name(base, name_ratio, block, seq, metric, hot_rows),
            earliest_with_key(base.where(F.col("match_address") != ""), "address_hash", seq, hot_rows).select(seq, "match", whole),
            nearest_within(base, "geo_lat", "geo_lng", tolerance, seq, hot_rows=hot_rows).select(seq, "match", (-F.col("distance")).alias("score"))]


def match_rows(df: DataFrame, seq: str = "seq", name_ratio: float = rules.FUZZY_NAME_RATIO,
               tolerance: float = rules.GEO_TOLERANCE, block_on: list[str] | None = None, metric: str = "levenshtein",
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """(seq, match, strategy): for each duplicate its match among earlier rows, first strategy that has one.

    A row may match a row that is itself a duplicate; ``resolve`` follows such chains to the row that is kept.
    ``block_on`` defaults to the city; pass ``[]`` to compare names everywhere.
    """
    block = ["city"] if block_on is None else block_on
    # four strategies read the normalised columns: stored once
    base = cut_lineage(with_match_columns(df).select(seq, *[c for c in dict.fromkeys([*block, "match_name", "match_key", "match_address", "address_hash", "geo_lat", "geo_lng"])]))
    tagged = [p.select(seq, "match", F.lit(i).alias("_s")) for i, p in enumerate(match_parts(base, seq, name_ratio, tolerance, block, metric, hot_rows))]
    all_ = tagged[0]
    for t in tagged[1:]:
        all_ = all_.unionByName(t)
    names = F.array(*[F.lit(s) for s in STRATEGIES])
    return (all_.groupBy(seq).agg(F.min(F.struct("_s", "match")).alias("m"))
            .select(seq, F.col("m.match").alias("match"), F.element_at(names, F.col("m._s") + 1).alias("strategy")))


def resolve(df: DataFrame, matches: DataFrame, seq: str = "seq") -> DataFrame:
    """Every row with its kept row (``root``), strategy and duplicate mark."""
    roots = components(matches, "match", seq)
    return (df.join(whole(matches), seq, "left").join(whole(roots.select(F.col("id").alias(seq), F.col("component").alias("root"))), seq, "left")
            .withColumn("root", F.coalesce("root", seq)).withColumn("is_duplicate", F.col("match").isNotNull()))


def dedup_statistics(resolved: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: totals, per-strategy matches, groups and rate."""
    dup = F.col("is_duplicate")
    hits = [F.count_if(dup & (F.col("strategy") == s)).alias(f"{s}_matches") for s in STRATEGIES]
    return resolved.agg(F.count(F.lit(1)).alias("total"), F.count_if(~dup).alias("unique_places"),
                        F.count_if(dup).alias("duplicates"), *hits,
                        F.count_distinct(F.when(dup, F.col("root"))).alias("duplicate_groups"),
                        F.round(F.try_divide(F.count_if(dup), F.count(F.lit(1))), 4).alias("duplicate_rate"))


def duplicate_groups(df: DataFrame, key: str, ident: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group_key, first_id, id, group_size): members of every key with two or more rows, one row per member."""
    groups = df.groupBy(F.col(key).alias("group_key")).agg(F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    rows = df.select(F.col(key).alias("group_key"), F.col(ident).alias("id"))
    return salted_join(rows, groups, ["group_key"], ["id"], "inner", hot_rows)


def event_links(events: DataFrame, ratio: float = rules.EVENT_TITLE_RATIO, metric: str = "levenshtein",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (id_a, id_b): equal identity key, or same day and venue with close titles.

    Expects seq, identity, day, norm_venue, norm_title.
    """
    exact = earliest_with_key(events, "identity", "seq", hot_rows).select(F.col("match").alias("id_a"), F.col("seq").alias("id_b"))
    placed = events.where(F.col("day").isNotNull() & (F.coalesce(F.col("norm_venue"), F.lit("")) != ""))
    close = similar_texts(placed, "seq", "norm_title", ratio, ["day", "norm_venue"], metric, True, hot_rows)
    return exact.unionByName(close.select("id_a", "id_b")).distinct()


def page_links(rows: DataFrame, page: str = "page_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges between similar rows of one page: name, name words, url, or same method and description words.

    Expects seq, name, url, method, description.
    """
    base = rows.withColumn("_name", F.lower(F.coalesce("name", F.lit(""))))
    base = base.withColumn("_words", F.array_distinct(F.filter(F.split("_name", r"\s+"), lambda w: w != "")))
    base = base.withColumn("_desc", F.array_distinct(F.filter(F.split(F.lower(F.coalesce("description", F.lit(""))), r"(?U)\W+"), lambda w: w != "")))

    def equal(keys: list[str], keep) -> DataFrame:
        rows_ = base.where(keep).select("seq", *keys)
        nodes = rows_.groupBy(*keys).agg(F.min("seq").alias("_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        return salted_join(rows_, nodes, keys, ["seq"], "inner", hot_rows).where(F.col("_id") < F.col("seq")) \
            .select(F.col("_id").alias("id_a"), F.col("seq").alias("id_b"))
    by_words = similar_sets_of(base, "_words", rules.NAME_JACCARD, [page], hot_rows)
    by_desc = similar_sets_of(base, "_desc", rules.DESCRIPTION_JACCARD, [page, "method"], hot_rows)
    return (equal([page, "_name"], F.lit(True)).unionByName(equal([page, "url"], F.coalesce(F.col("url"), F.lit("")) != ""))
            .unionByName(by_words).unionByName(by_desc).distinct())


def similar_sets_of(base: DataFrame, words: str, above: float, block: list[str], hot_rows: int) -> DataFrame:
    from .similarity import similar_sets
    return similar_sets(base, "seq", words, above, block, hot_rows).select("id_a", "id_b")
