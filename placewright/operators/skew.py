"""Joins that survive a key holding a large share of all rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

SALTS = 64
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], at_least: int = HOT_ROWS) -> DataFrame:
    """Every key with ``at_least`` rows. There are at most rows / ``at_least`` of them, so Spark broadcasts the list
    while it is small and joins it by key beyond that. The count is combined on the map side before it is shuffled.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= at_least).select(*keys)


def whole(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the rows: it is sorted and merged and never built in the driver, however few bytes its columns take in files."""
    return df.hint("merge")


def measured_join(left: DataFrame, right: DataFrame, keys: list[str], salt_on: list[str], how: str = "inner", at_least: int = HOT_ROWS) -> DataFrame:
    """A join that is salted where, and only where, the left side has hot keys; they are counted first, so the usual plan is a plain join."""
    hot = written(hot_keys(left, keys, at_least))
    return left.join(whole(right), keys, how) if hot.isEmpty() else salted_join(left, right, keys, salt_on, how, at_least, hot=hot)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_on: list[str], how: str = "inner",
                at_least: int = HOT_ROWS, salts: int = SALTS, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join in which hot keys of the left side are spread over ``salts`` tasks.

    Only rows of hot keys are replicated on the right. The salt comes from a hash of ``salt_on``, so a
    recomputed task gives the same rows. ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join keeps the left side only: {how}")
    mark = (hot if hot is not None else hot_keys(left, keys, at_least)).withColumn("_hot", F.lit(1))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(mark, keys, "left").withColumn("_salt", salt).drop("_hot")
    b = right.join(mark, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return a.join(whole(b), [*keys, "_salt"], how).drop("_salt")
