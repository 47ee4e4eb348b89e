"""Keeping tables current: upsert, patch, delete, log, validation, schema growth."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def latest_per_key(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """One row per key, the one with the highest version; rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns))


def upsert_events(base: DataFrame, batch: DataFrame, key: str = "id", stamp: str = "fetched_at",
                  order: str | None = None) -> DataFrame:
    """The batch wins for all columns; the stamp never goes back. Within the batch the last row (``order``, in its own type) wins,
    rows of one order by content."""
    last = order or stamp
    a = base.withColumn("_gen", F.lit(0)).withColumn("_ord", F.lit(None).cast(batch.schema[last].dataType))
    b = batch.withColumn("_gen", F.lit(1)).withColumn("_ord", F.col(last))
    both = a.unionByName(b, allowMissingColumns=True)
    rest = [c for c in base.columns if c not in (key, stamp)]
    new_columns = [c for c in batch.columns if c not in base.columns and c != order]
    rest += new_columns
    merged = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_gen", "_ord", F.to_json(F.struct(*rest)).alias("_tie"))).alias("_r"), F.max(stamp).alias(stamp))
    return merged.select(key, stamp, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*base.columns, *new_columns)


def first_version(batch: DataFrame, key: str, stamp: str, order: str | None = None) -> DataFrame:
    """What an upsert into an empty table gives: the last row per key with the highest stamp seen."""
    return upsert_events(batch.limit(0), batch, key, stamp, order)


def insert_or_replace(base: DataFrame, batch: DataFrame, order: str, key: str = "id",
                      unique: tuple[str, str] = ("source", "source_url")) -> DataFrame:
    """Later rows replace earlier ones that share the id, or the (source, url) pair.

    A row is dropped when any later row has its id or its pair; rows with a null pair member clash by id only.
    """
    last = base.agg(F.max(order)).first()[0]
    rows = base.unionByName(batch.withColumn(order, F.col(order) + F.lit(0 if last is None else last + 1)))
    paired = F.col(unique[0]).isNotNull() & F.col(unique[1]).isNotNull()
    newest = latest_per_key(rows, [key], [F.col(order)])
    last_of_pair = rows.where(paired).groupBy(*unique).agg(F.max(order).alias(order)).select(order)
    return newest.where(paired).join(last_of_pair, order, "left_semi").unionByName(newest.where(~paired))


def patch(base: DataFrame, changes: DataFrame, key: str = "id", stamp: str | None = "updated_at",
          as_of: Column | None = None) -> DataFrame:
    """Set only the non-null columns of the change row; rows with any change get the time stamp."""
    fields = [c for c in changes.columns if c != key and c in base.columns]
    ch = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = base.join(ch, key, "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"_n_{c}", c))
    if stamp and as_of is not None:
        touched = F.lit(False)
        for c in fields:
            touched = touched | F.col(f"_n_{c}").isNotNull()
        out = out.withColumn(stamp, F.when(F.col("_hit") & touched, as_of).otherwise(F.col(stamp)))
    return out.select(*base.columns)


def delete_keys(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def guarded(base: DataFrame, requested: DataFrame, key: str = "id") -> DataFrame:
    """(key, done): whether each requested key exists, and so whether the change took place."""
    known = base.select(key).distinct().withColumn("_k", F.lit(True))
    return requested.select(key).distinct().join(known, key, "left").select(key, F.coalesce("_k", F.lit(False)).alias("done"))


def ingest_log_row(batch: DataFrame, source: str, as_of: Column, ok: bool = True, note: str | None = None) -> DataFrame:
    return batch.agg(F.count(F.lit(1)).alias("count")).select(
        as_of.alias("ts"), F.lit(source).alias("source"), "count", F.lit(ok).alias("ok"), F.lit(note).cast("string").alias("note"))


def ingest_log(batch: DataFrame, source: str, as_of: Column) -> DataFrame:
    """One log row per source of the batch."""
    return batch.groupBy(col(source).alias("source")).agg(F.count(F.lit(1)).alias("count")).select(
        as_of.alias("ts"), "source", "count", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("note"))


def append_with_new_columns(base: DataFrame, batch: DataFrame) -> DataFrame:
    return base.unionByName(batch, allowMissingColumns=True)


def validity(df: DataFrame, required: list[str]) -> Column:
    """First missing required field, null for a good row."""
    chain = None
    for name in required:
        bad = F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""
        chain = F.when(bad, F.lit(f"missing_{name}")) if chain is None else chain.when(bad, F.lit(f"missing_{name}"))
    return chain


def validate_rows(df: DataFrame, required: list[str], source_name: str, order: list[Column],
                  limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows with the source filled in, rejected rows with the reason); the limit applies after validation."""
    marked = df.withColumn("reason", validity(df, required))
    good = marked.where(F.col("reason").isNull()).drop("reason").withColumn(
        "source", F.coalesce(F.when(F.trim("source") != "", F.col("source")), F.lit(source_name)))
    if limit is not None:
        good = good.orderBy(*order).limit(limit)
    return good, marked.where(F.col("reason").isNotNull())


def validation_counts(df: DataFrame, required: list[str]) -> DataFrame:
    return df.select(F.coalesce(validity(df, required), F.lit("ok")).alias("reason")).groupBy("reason").count()


def pick_columns(df: DataFrame, wanted: dict[str, list[str]], kind: str = "string") -> DataFrame:
    """Schema-tolerant projection: the first candidate column that exists, else null."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for target, names in wanted.items():
        hit = next((have[n.lower()] for n in names if n.lower() in have), None)
        out.append((F.col(hit) if hit else F.lit(None).cast(kind)).alias(target))
    return df.select(*out)


# ---- nested values as text -------------------------------------------------------------------

def decode_list(text: Column | str) -> Column:
    """JSON text to a list; anything unreadable is an empty list."""
    return F.coalesce(F.from_json(col(text), "array<string>"), F.array().cast("array<string>"))


def decode_flags(text: Column | str) -> Column:
    return F.coalesce(F.from_json(col(text), "map<string,boolean>"), F.create_map().cast("map<string,boolean>"))


def encode(value: Column | str) -> Column:
    return F.to_json(col(value))


def joined(values: Column | str) -> Column:
    return F.concat_ws(",", col(values))
