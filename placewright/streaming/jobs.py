"""Structured Streaming: micro-batch ingest, stateful dedup, rolling metrics, upsert sink."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tables
from ..operators.facets import freshness_state
from ..session import cut_lineage
from ..sources.store import BUCKETS, MOST_PARTS, Store, current, latest


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def file_stream(spark: SparkSession, table: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of a table, which is a folder of part files or one file."""
    path, fs = _path(spark, table)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(table)
    return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None,
                mode: str = "append") -> StreamingQuery:
    """One run at a time, every given interval, or once over all that is there."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def keyed_upsert(root: str, key: str, stamp: str, order: str | None = None, log_source: str | None = None, buckets: int = BUCKETS,
                 most_parts: int = MOST_PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: table ``rows`` in hash buckets of the key, and ``log`` with what each source gave.

    A batch writes its own rows, one per key, and their log in one change; a replayed batch changes nothing. Buckets that
    have gathered many parts are rewritten.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        change = Store(batch.sparkSession, root, buckets).change(batch_id)
        if change is None:
            return
        rows = cut_lineage(batch)
        change.put("rows", tables.first_version(rows, key, stamp, order), [key])
        if log_source:
            change.put("log", tables.ingest_log(rows, log_source, F.current_timestamp()).withColumn("batch_id", F.lit(batch_id)))
        change.compact("rows", latest([key], stamp), most_parts)
        change.commit()
    return write


def upserted(spark: SparkSession, root: str, key: str, stamp: str) -> DataFrame:
    """What a keyed sink has stored: of each key the last batch's columns, with the highest stamp."""
    return current(Store(spark, root), "rows", [key], stamp)


def drop_exact_copies(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Exact keys only: state is kept within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def rolling_metrics(stream: DataFrame, keys: list[str], ts: str, value: str, delay: str = "5 minutes", length: str = "15 minutes", step: str = "1 minute") -> DataFrame:
    """Counts, sums and means per sliding window; windows older than the watermark leave the state."""
    w = F.window(F.col(ts), length, step)
    return (stream.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
            .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total"))


def keyed_states(root: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink in update mode: the last state of each key wins, so open windows are kept too."""
    def write(batch: DataFrame, batch_id: int) -> None:
        change = Store(batch.sparkSession, root, buckets).change(batch_id)
        if change is None:
            return
        change.put("rows", batch, keys)
        change.compact("rows", latest(keys))
        change.commit()
    return write


def last_states(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    return current(Store(spark, root), "rows", keys)


def expired_keys(stream: DataFrame, key: str, ts: str, ttl_s: int, delay: str = "0 seconds") -> DataFrame:
    """(key, last): a key leaves the state, and is given out, once nothing newer has come for ``ttl_s`` seconds of event time.

    Only the newest time of each live key is kept. A key that comes back starts anew.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        if not state.hasTimedOut:
            last = max([*([last] if last is not None else []), *(int(f["us"].max()) for f in frames)])
            until = last // 1000 + ttl_s * 1000
            if until > state.getCurrentWatermarkMs():
                state.update((last,))
                state.setTimeoutTimestamp(until)
                return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"key": [group[0]], "last": pd.to_datetime([last], unit="us")})

    rows = stream.withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(ts), F.unix_micros(ts).alias("us")).where(F.col("key").isNotNull() & F.col("us").isNotNull())
    gone = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, last timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return gone.withColumnRenamed("key", key)


def append_parquet(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def live_rows(index: DataFrame, as_of, ttl: int = 1200, margin: int = 300) -> DataFrame:
    """Index rows that are fresh or stale; expiry is a filter on read."""
    return index.withColumn("state", freshness_state("built_at", as_of, ttl, margin)).where(F.col("state") != "miss")
