"""Writing tables, the facet index and reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_facets(rows: DataFrame, path: str) -> None:
    """City and day folders; only the folders in the data are replaced, large days spread over files by id."""
    salted = rows.repartition("city", "day", F.pmod(F.xxhash64("id" if "id" in rows.columns else "key"), F.lit(16)))
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city", "day").parquet(path)


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines, or one text column as text."""
    (df.write.mode("overwrite").json if kind == "json" else df.write.mode("overwrite").text)(path)


def snapshot_path(ident: Column | str, ts: Column | str) -> Column:
    """YYYY/MM/DD/<id>.html.gz"""
    return F.concat(F.date_format(col(ts), "yyyy/MM/dd/"), col(ident).cast("string"), F.lit(".html.gz"))


def write_pages(df: DataFrame, path: str, ts: str) -> None:
    """Raw pages by year, month and day, compressed."""
    (df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)).withColumn("day", F.dayofmonth(ts))
     .write.mode("append").partitionBy("year", "month", "day").option("compression", "gzip").json(path))
