"""Report tables. Counts combine on the map side; exploded lists are reduced before any shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import present
from ..functions.text import col
from .quantiles import exact_percentiles


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def exact_mean(value: str, digits: int) -> Column:
    """Mean of decimal numbers kept as doubles, halves rounded up: summed as decimals, so the order of the rows does not decide on a half.

    Numbers that no decimal of 12 places and 16 digits before them holds (NaN, infinite, very large) are averaged as doubles.
    """
    exact = F.col(value).try_cast("decimal(28,12)")
    odd = F.count_if(F.col(value).isNotNull() & exact.isNull()) > 0
    return F.round(F.when(odd, F.avg(value)).otherwise(F.avg(exact).cast("double")), digits)


def table_totals(df: DataFrame, quality: str = "quality_score", stamp: str = "updated_at") -> DataFrame:
    q = F.col(quality)
    return df.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(F.when(q > 0, q)), 4).alias("avg_quality"),
                  F.min(stamp).alias("first_update"), F.max(stamp).alias("last_update"))


def counts_by(df: DataFrame, column: str, label: str, top: int | None = None) -> DataFrame:
    """(kind, key, n) for one column; with ``top`` only the largest keys."""
    out = df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("kind"), "key", "n")
    return out.orderBy(F.desc("n"), F.col("key").asc_nulls_last()).limit(top) if top else out


def list_counts(df: DataFrame, column: str, label: str) -> DataFrame:
    return df.select(F.explode(column).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("kind"), "key", "n")


def table_statistics(df: DataFrame, flags: str = "flags") -> DataFrame:
    """(kind, key, n) by source, city, top ten areas and flag.

    One pass: every row gives its few (kind, key) cells, which combine on the map side.
    """
    cells = F.concat(F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")),
                             F.struct(F.lit("city").alias("kind"), F.col("city").alias("key")),
                             F.struct(F.lit("area").alias("kind"), F.col("area").alias("key"))),
                     F.transform(F.coalesce(F.col(flags), F.array().cast("array<string>")), lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("key"))))
    n = df.select(F.explode(cells).alias("c")).select("c.kind", "c.key").where(F.col("key").isNotNull()).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    areas = n.where(F.col("kind") == "area").orderBy(F.desc("n"), "key").limit(10)
    return n.where(F.col("kind") != "area").unionByName(areas)


def city_statistics(df: DataFrame, category: str, price: str, rating: str) -> DataFrame:
    """(city, kind, key, n, mean_rating): by category, by price, and overall."""
    cells = F.concat(F.transform(col(category), lambda c: F.struct(F.lit("category").alias("kind"), c.alias("key"))),
                     F.array(F.struct(F.lit("price").alias("kind"), col(price).cast("string").alias("key")), F.struct(F.lit("all").alias("kind"), F.lit("all").alias("key"))))
    one = df.select("city", col(rating).alias("_r"), F.explode(cells).alias("c"))
    return one.groupBy("city", F.col("c.kind").alias("kind"), F.col("c.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), exact_mean("_r", 1).alias("mean_rating"))


def flag_labels(df: DataFrame, flags: str) -> DataFrame:
    """Distinct flags with a readable label."""
    return df.select(F.explode(flags).alias("flag")).distinct().withColumn("label", F.initcap(F.replace("flag", F.lit("_"), F.lit(" "))))


def event_quality(df: DataFrame, keys: list[str], start: str, end: str, image: str, description: str) -> DataFrame:
    """Fill rates, image rate and description lengths, overall (no keys) or per key.

    Lengths are whole numbers, so the median is taken over counted lengths.
    """
    n = F.sum("_c")
    filled = F.coalesce(F.col(description), F.lit("")) != ""
    base = df.select(*keys, F.col(start).isNotNull().alias("_s"), F.col(end).isNotNull().alias("_e"),
                     (F.coalesce(F.col(image), F.lit("")) != "").alias("_i"), F.when(filled, F.length(description)).alias("_l"))
    small = base.groupBy(*keys, "_s", "_e", "_i", "_l").agg(F.count(F.lit(1)).alias("_c"))

    def share(flag: str) -> Column:
        return pct(F.sum(F.when(F.col(flag), F.col("_c")).otherwise(0)), n)
    length_sum = F.sum(F.col("_l") * F.col("_c"))
    length_n = F.sum(F.when(F.col("_l").isNotNull(), F.col("_c")))
    return small.groupBy(*keys).agg(
        n.alias("total"), share("_s").alias("start_pct"), share("_e").alias("end_pct"), share("_i").alias("image_pct"),
        F.coalesce(F.round(F.try_divide(length_sum, length_n), 2), F.lit(0.0)).alias("avg_desc_len"),
        F.coalesce(F.percentile("_l", F.lit(0.5), F.col("_c")), F.lit(0.0)).alias("median_desc_len"))


def duplicate_percent(df: DataFrame, identity: str) -> DataFrame:
    groups = df.groupBy(identity).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("duplicate_groups"),
                      F.sum(F.col("n") - 1).alias("duplicate_events"), pct(F.sum(F.col("n") - 1), F.sum("n")).alias("duplicates_pct"))


def quality_run(df: DataFrame, accepted: str, scores: list[str]) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.col(accepted))
    return df.agg(n.alias("total"), ok.alias("accepted"), (n - ok).alias("rejected"), F.round(F.try_divide(ok, n), 4).alias("acceptance_rate"),
                  *[F.round(F.avg(s), 4).alias(f"avg_{s}") for s in scores])


def source_statistics(df: DataFrame, source: str, flags: str, area: str) -> DataFrame:
    """Rows by source, flag and area."""
    return df.select(F.col(source).alias("source"), F.col(area).alias("area"), F.explode(flags).alias("flag")).groupBy("source", "flag", "area").agg(F.count(F.lit(1)).alias("n"))


def level_distribution(df: DataFrame, level: str) -> DataFrame:
    return df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))


def status_statistics(df: DataFrame, status: str = "status") -> DataFrame:
    n, s = F.count(F.lit(1)), F.col(status)
    return df.agg(n.alias("total"), F.count_if(s == "new").alias("new_places"), F.count_if(s == "duplicate").alias("duplicates"),
                  F.count_if(s == "rejected").alias("rejected"), F.count_if(s == "error").alias("errors"),
                  F.round(F.try_divide(F.count_if(s == "new"), n), 4).alias("success_rate"), F.round(F.try_divide(F.count_if(s == "error"), n), 4).alias("error_rate"))


def change_statistics(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows, changed fields and removed characters for (before, after) column pairs."""
    def changed(a, b):
        return F.coalesce(F.col(a), F.lit("")) != F.coalesce(F.col(b), F.lit(""))
    fields, removed = F.lit(0), F.lit(0)
    for a, b in pairs.values():
        fields = fields + changed(a, b).cast("int")
        removed = removed + F.greatest(F.length(F.coalesce(F.col(a), F.lit(""))) - F.length(F.coalesce(F.col(b), F.lit(""))), F.lit(0))
    each = [F.count_if(changed(a, b)).alias(f"{name}_changed") for name, (a, b) in pairs.items()]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(fields).alias("fields_normalized"), F.sum(removed).alias("characters_removed"), *each)


def extraction_summary(df: DataFrame, method: str = "method", confidence: str = "confidence") -> DataFrame:
    return df.groupBy(method).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(confidence), 4).alias("avg_confidence"), F.min(confidence).alias("min_confidence"), F.max(confidence).alias("max_confidence"))


def missing_fields(df: DataFrame, fields: list[str]) -> tuple[Column, Column]:
    """(score 0..100, names of missing fields)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    has = {f: present(f, kinds[f]) for f in fields}
    total = F.lit(0)
    for f in fields:
        total = total + F.when(has[f], 1).otherwise(0)
    return F.round(total * 100.0 / len(fields), 2), F.array_compact(F.array(*[F.when(~has[f], F.lit(f)) for f in fields]))


def collection_report(df: DataFrame, fields: list[str], by: str) -> DataFrame:
    score, missing = missing_fields(df, fields)
    one = df.select(F.col(by).alias("key"), score.alias("score"), missing.alias("missing"))
    return one.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 2).alias("mean_score"), *[F.count_if(F.array_contains("missing", f)).alias(f"missing_{f}") for f in fields])


def diagnostics(days: DataFrame, source: str, flags: str) -> DataFrame:
    """(kind, key, n) by source, day and flag plus the rows without any flag; expects one row per event day."""
    cells = F.concat(F.array(F.struct(F.lit("source").alias("kind"), F.col(source).alias("key")), F.struct(F.lit("day").alias("kind"), F.col("day").cast("string").alias("key"))),
                     F.when(F.size(flags) > 0, F.transform(flags, lambda f: F.struct(F.lit("flag").alias("kind"), f.alias("key")))).otherwise(F.array(F.struct(F.lit("unflagged").alias("kind"), F.lit("all").alias("key")))))
    return days.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.key").agg(F.count(F.lit(1)).alias("n"))


def unflagged_sample(df: DataFrame, flags: str, order: list[Column], n: int = 10) -> DataFrame:
    return df.where(F.size(flags) == 0).orderBy(*order).limit(n)


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return exact_percentiles(df, keys, value, {"p50": 0.50, "p95": 0.95, "p99": 0.99})


def hit_rate(df: DataFrame, keys: list[str], is_hit: Column, is_miss: Column, value: str) -> DataFrame:
    hits, misses = F.count_if(is_hit), F.count_if(is_miss)
    return df.groupBy(*keys).agg(hits.alias("hits"), misses.alias("misses"), F.coalesce(F.round(F.try_divide(hits, hits + misses), 4), F.lit(0.0)).alias("hit_rate"),
                                 F.coalesce(F.round(F.try_divide(misses, hits + misses), 4), F.lit(0.0)).alias("miss_rate"), F.coalesce(F.round(F.avg(value), 4), F.lit(0.0)).alias("mean_ms"))


THRESHOLDS = {"min_hit_rate": 0.6, "min_requests": 10, "max_cache_p95_ms": 120.0, "max_db_p95_ms": 500.0}


def threshold_alerts(metrics: DataFrame, limits: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(keys, type, severity, current, threshold) of every crossed limit; expects hits, misses, hit_rate, cache_p95, db_p95."""
    def alert(test, kind, severity, current, limit):
        return F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), current.cast("double").alias("current"), F.lit(float(limit)).alias("threshold")))
    enough = F.col("hits") + F.col("misses") >= limits["min_requests"]
    rows = F.array_compact(F.array(
        alert(enough & (F.col("hit_rate") < limits["min_hit_rate"]), "low_hit_rate", "warning", F.col("hit_rate"), limits["min_hit_rate"]),
        alert(F.col("cache_p95") > limits["max_cache_p95_ms"], "high_cache_latency", "warning", F.col("cache_p95"), limits["max_cache_p95_ms"]),
        alert(F.col("db_p95") > limits["max_db_p95_ms"], "high_db_latency", "critical", F.col("db_p95"), limits["max_db_p95_ms"])))
    keep = [c for c in metrics.columns if c not in ("hits", "misses", "hit_rate", "miss_rate", "mean_ms", "cache_p95", "db_p95")]
    return metrics.select(*keep, F.explode(rows).alias("a")).select(*keep, "a.*")


def index_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("key").agg(F.sum(F.size("ids")).alias("total"))


def rolling_counts(df: DataFrame, keys: list[str], ts: str, value: str, length: str = "15 minutes", step: str = "1 minute") -> DataFrame:
    """Sliding windows of counts, sums and means.

    Rows are first combined per step, so each minute travels once and is then added to the windows that hold it.
    """
    small = df.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), step).alias("w")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    flat = small.select(*keys, F.col("w.start").alias("_at"), "_n", "_s")
    out = flat.groupBy(*keys, F.window("_at", length, step).alias("w")).agg(F.sum("_n").alias("n"), F.sum("_s").alias("total"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total", (F.col("total") / F.col("n")).alias("mean"))
