"""Exact percentiles per group without holding a group in one task."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: a sketch's ranks are off by a group's rows divided by this at most
ACCURACY = 10_000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Linear-interpolated percentiles (index p*(n-1)); one row per group, one column per point.

    A mergeable sketch of each group brackets every wanted rank, whatever the values' spread. One exact pass then counts what lies
    below a bracket and each value inside it, and only these (some ten-thousandths of a group, or all of a group smaller than
    ``accuracy``) are ordered. Keys must not be null.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(1)), ["_all"]
    low, high = float("-inf"), float("inf")
    # the rank itself, the sketch's error on either side, and one rank for the neighbour that is interpolated with
    ends = [end for p in points.values() for end in (p - 3 / accuracy, p + 3 / accuracy)]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [min(max(e, 0.0), 1.0) for e in ends], accuracy).alias("_q"))
    small = F.col("_n") <= accuracy
    def end(k: int, open_end: float):
        """A quantile of the sketch, open where the group is small or there is nothing beyond."""
        beyond = ends[k] <= 0 or ends[k] >= 1
        return F.lit(open_end) if beyond else F.when(small, F.lit(open_end)).otherwise(F.get("_q", F.lit(k)))
    brackets = F.array(*[F.struct(F.lit(name).alias("_name"), (F.lit(p) * (F.col("_n") - 1)).alias("_pos"), end(2 * i, low).alias("_lo"), end(2 * i + 1, high).alias("_hi"))
                         for i, (name, p) in enumerate(points.items())])
    wanted = sketch.select(*keys, F.explode(brackets).alias("_b")).select(*keys, "_b.*")
    near = rows.join(wanted, keys).where(F.col("_v") <= F.col("_hi"))
    counted = near.groupBy(*keys, "_name", "_pos", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy(F.col("_v").asc_nulls_first()))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = counted.withColumn("_upto", upto).groupBy(*keys, "_name").agg(F.first("_pos").alias("_pos"), at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_z"))
    between = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, between)).alias(n) for n in points]).drop("_all")
