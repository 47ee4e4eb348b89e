"""Sources and sinks through real files in the shared folder: JSON arrays, the newest snapshot, reports, facet folders."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import facets as FA
from ..operators import reports as R
from ..session import work_dir
from ..sources import readers, sinks
from ..sources.readers import table
from .facet_q import FACET_SQL, _rows
from .inputs import places, with_places, with_shows
from .registry import query

#: records of one JSON array file
FILE_ROWS = 2000


def _folder(spark) -> str:
    return f"{work_dir(spark)}/files-{uuid.uuid4().hex}"


def _arrays(df, chunk):
    """One JSON array per chunk of rows, as text with the chunk as folder."""
    return df.groupBy(chunk.alias("chunk")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*df.columns))), ","), F.lit("]")).alias("value"))


@query("json_array_files", "S1 S24", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def _(spark, sf):
    path = _folder(spark)
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    _arrays(rows, F.floor(F.col("c_custkey") / FILE_ROWS)).repartition("chunk").write.partitionBy("chunk").text(path)
    return readers.json_array(spark, f"{path}/*/*.txt", rows.schema)


@query("newest_snapshot", "S8", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    """An older snapshot lacks half of the rows; the pattern holds both files. A snapshot is one file by its nature."""
    path = _folder(spark)
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    for part in (rows.where("s_suppkey % 2 = 0"), rows):
        _arrays(part, F.lit(0)).select("value").coalesce(1).write.mode("append").text(path)
    return readers.newest_file(spark, f"{path}/part-*.txt", rows.schema)


@query("report_files", "S21 A1", with_places("SELECT 'city' AS kind, city AS key, count(*) AS n FROM places GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM places GROUP BY 2 UNION ALL SELECT 'text', 'lines', count(DISTINCT city) FROM places"))
def _(spark, sf):
    """A report as JSON lines and as text, both read back."""
    path, df = _folder(spark), places(spark, sf)
    report = R.table_statistics(df).where(F.col("kind").isin("city", "source")).select("kind", "key", "n")
    sinks.write_report(report, f"{path}/json")
    sinks.write_report(report.where("kind = 'city'").select(F.concat_ws(": ", "key", F.col("n").cast("string")).alias("line")), f"{path}/text", "text")
    lines = spark.read.text(f"{path}/text").agg(F.count(F.lit(1)).alias("n")).select(F.lit("text").alias("kind"), F.lit("lines").alias("key"), "n")
    return spark.read.schema(report.schema).json(f"{path}/json").unionByName(lines)


@query("facet_files", "S19 S20 C3", with_shows(FACET_SQL + "SELECT city, day, kind, key, count(*) AS n FROM rows WHERE NOT (day = '2024-01-03' AND kind = 'category') GROUP BY 1, 2, 3, 4"))
def _(spark, sf):
    """The index as folders per city and day; one day is written anew without its categories, the others stay."""
    path, rows = _folder(spark), _rows(spark, sf)
    sinks.write_facets(rows, path)
    sinks.write_facets(rows.where("day = date '2024-01-03' and kind = 'flag'"), path)
    held = spark.read.parquet(path)
    return FA.facet_counts(held).withColumn("day", F.col("day").cast("string"))
