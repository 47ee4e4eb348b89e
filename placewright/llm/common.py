"""Small helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: computed once, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, ident: str) -> tuple[Column, Callable[[str], Column]]:
    """An id as text, and the way back: a null among whole numbers would turn a pandas column into floats and lose digits."""
    kind = df.schema[ident].dataType
    if kind.simpleString() == "binary":
        return F.hex(ident), lambda c: F.unhex(c)
    return F.col(ident).cast("string"), lambda c: F.col(c).cast(kind)


def folded(i, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.crc32(F.col(i).cast("string").cast("binary")) % modulus
