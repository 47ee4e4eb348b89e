"""Reading tables, JSON arrays, other databases and rule files."""
from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: T.StructType = schemas.CATALOGUE_PLACE) -> DataFrame:
    """A file holding one JSON array of records, with a fixed schema. Each file is one task: split large data in files."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by another database; pass partitionColumn, lowerBound, upperBound and numPartitions for large ones."""
    return spark.read.format("jdbc").options(url=url, **({"dbtable": f"({query}) t"} if "partitionColumn" in options else {"query": query}), **options).load()


def newest_file(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Rows of the newest file of a pattern. Modification times are metadata, so older files are not read for rows."""
    base = spark.read.schema(schema).option("multiLine", True).json(pattern)
    stamped = base.select("*", F.col("_metadata.file_modification_time").alias("_m"), F.col("_metadata.file_path").alias("_p"))
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).first()
    return base.limit(0) if newest is None else stamped.where(F.col("_p") == F.lit(newest["path"])).drop("_m", "_p")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of whole page files; the path stands in for the address."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


# ---- rule files ------------------------------------------------------------------------------------

def _load(path: str):
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml
        return yaml.safe_load(text)
    return json.loads(text)


def tag_grammar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[tuple[str, list[str], float]]]:
    """(tag_dim, synonym_dim, combinations) of a grammar file: categories with level, priority and synonyms per language."""
    data = _load(path)
    tags, synonyms, n = [], [], 0
    for i, (name, body) in enumerate(data["categories"].items()):
        tags.append((name, body.get("level"), int(body.get("priority", 999)), body.get("description", ""), i))
        for language in ("en", "th"):
            for word in body.get(f"{language}_synonyms", []):
                synonyms.append((word, language, name, n))
                n += 1
    combos = [(c["name"], list(c["tags"]), float(c["weight"])) for c in data.get("combinations", [])]
    return spark.createDataFrame(tags, schemas.TAG_DIM), spark.createDataFrame(synonyms, schemas.SYNONYM_DIM), combos


def category_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(c["id"], c.get("label"), list(c.get("tags", []))) for c in _load(path)], "id string, label string, tags array<string>")


def source_map(spark: SparkSession, path: str) -> DataFrame:
    rows = [(k, s, i) for k, ss in _load(path).items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "category string, source string, ord int")


def area_synonyms(spark: SparkSession, table_: dict[str, list[str]]) -> DataFrame:
    rows, n = [], 0
    for area, words in table_.items():
        for word in words:
            rows.append((area, word, n))
            n += 1
    return spark.createDataFrame(rows, schemas.AREA_DIM)


def plain_area_synonyms(names: list[str]) -> dict[str, list[str]]:
    """The usual spellings of an area: bare, road, area and district."""
    return {n: [n, f"{n} road", f"{n} area", f"{n} district"] for n in (x.lower() for x in names)}


# ---- shaping foreign rows -----------------------------------------------------------------------------

def to_curation_shape(df: DataFrame) -> DataFrame:
    """A foreign place row in the curation schema; one photo is made of the image address."""
    have = set(df.columns)

    def pick(name: str, kind: str = "string", default: Column | None = None) -> Column:
        base = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return F.coalesce(base, default) if default is not None else base
    empty = F.array().cast("array<string>")
    photo = F.array(F.struct(pick("image_url").alias("url"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), pick("name").alias("alt_text")))
    return df.select(
        pick("id").alias("id"), pick("name").alias("name"), pick("city", default=F.lit("bangkok")).alias("city"), pick("domain").alias("domain"),
        pick("url").alias("url"), pick("description").alias("description"), pick("address").alias("address"), pick("lat", "double").alias("geo_lat"),
        pick("lon", "double").alias("geo_lng"), (F.coalesce(F.col("tags"), empty) if "tags" in have else empty).alias("tags"),
        (F.coalesce(F.col("flags"), empty) if "flags" in have else empty).alias("flags"),
        F.when(F.coalesce(pick("image_url"), F.lit("")) != "", photo).otherwise(F.array().cast(f"array<{schemas.PHOTO.simpleString()}>")).alias("photos"),
        pick("image_url").alias("image_url"), pick("rating", "double").alias("rating"), pick("popularity", "double", F.lit(0.5)).alias("popularity"),
        pick("price_level", "int", F.lit(2)).alias("price_level"))


def event_shape(df: DataFrame) -> DataFrame:
    """The canonical event row: trimmed title, blank texts to null, tags never null."""
    def text(name: str) -> Column:
        return F.when(F.trim(name) != "", F.trim(name))
    return df.select(F.trim("title").alias("title"), "date", "end", "time", F.col("category_hint").alias("category"), text("venue").alias("venue"), text("address").alias("address"),
                     text("desc").alias("desc"), "popularity", "price_min", "rating", text("subtitle").alias("subtitle"),
                     F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "image", "source", "url")


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All sources with their position; a missing column is null."""
    out = None
    for i, (name, df) in enumerate(parts.items()):
        one = df.withColumn("source_name", F.lit(name)).withColumn("source_pos", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def retried(read, attempts: int = 3, wait_s: float = 0.3) -> DataFrame:
    """The frame that ``read`` gives, tried again after growing waits; the last failure is raised. Only the schema is read here."""
    for attempt in range(1, attempts + 1):
        try:
            df = read()
            df.schema
            return df
        except Exception:
            if attempt == attempts:
                raise
            time.sleep(wait_s * attempt)


def readable(read, empty: DataFrame, attempts: int = 3, wait_s: float = 0.3) -> DataFrame:
    """A source that fails every time gives no rows instead of failing the union."""
    try:
        return retried(read, attempts, wait_s)
    except Exception:  # the source is unreachable or unreadable
        return empty


def read_and_log(read, empty: DataFrame, source: str, as_of: Column, attempts: int = 3, wait_s: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(rows, log row): a source that fails every time gives no rows, and the log says that it failed and why."""
    from ..operators.tables import ingest_log_row
    try:
        rows = retried(read, attempts, wait_s)
        return rows, ingest_log_row(rows, source, as_of)
    except Exception as failure:  # unreachable or unreadable: kept in the log
        return empty, ingest_log_row(empty, source, as_of, False, f"{type(failure).__name__}: {failure}"[:500])
