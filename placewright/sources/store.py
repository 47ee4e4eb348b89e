"""Tables that grow by runs: parts in hash buckets, and a manifest under which all tables of a run change together.

A run writes new folders only and then one manifest that names the folders of every table. Readers follow the newest
manifest, so a run that is lost half way leaves the old state, and a run number that is already in the manifest is not
applied again. A keyed part holds one row per key, dealt into buckets by a hash of the key: an upsert writes the rows
of its batch alone, reading merges the parts of a bucket, and compaction rewrites only buckets that have many parts. When a
bucket holds more than ``bucket_rows`` rows on average the number of buckets doubles, so what a lookup reads stays bounded.
One writer at a time: a manifest that is already there is not replaced.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, BUCKET_ROWS, MOST_PARTS = 16, 500_000, 8
Merge = Callable[[DataFrame], DataFrame]


class Store:
    """The tables under one root. ``read`` gives stored rows with ``_run``, the run that wrote them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.root, self.buckets, self.bucket_rows = spark, root.rstrip("/"), buckets, bucket_rows

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._fs(folder)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def state(self) -> dict:
        """The newest manifest: its version, the last run, the tables and other values kept with them."""
        made = [n for n in self._names(f"{self.root}/manifests") if n.endswith(".json") and not n.startswith((".", "_"))]
        if not made:
            return {"version": 0, "run": -1, "tables": {}, "values": {}}
        path, fs = self._fs(f"{self.root}/manifests/{max(made)}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """Written aside and renamed, so that a manifest is there whole or not at all."""
        made, fs = self._fs(f"{self.root}/manifests/{state['version']:010d}.json")
        aside, _ = self._fs(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if fs.exists(made) or not fs.rename(aside, made):
            raise RuntimeError(f"another writer has published {made.getName()}")

    def bucket(self, keys: list[str], count: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")

    def read(self, name: str, keys: DataFrame | None = None, state: dict | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """Rows of all live parts; with ``keys`` (the key columns alone) only the buckets that these keys can stand in."""
        entry = (state or self.state())["tables"][name]
        if keys is not None:
            # as many numbers as there are buckets at most
            only = [r[0] for r in keys.select(self.bucket(entry["keys"], entry["buckets"])).distinct().collect()]
        schema = T.StructType.fromJson(entry["schema"])
        out = None
        for part in entry["parts"]:
            rows = self.spark.read.schema(_with_bucket(T.StructType.fromJson(part["schema"]), part["buckets"])).parquet(f"{self.root}/{part['path']}")
            if part["buckets"] is not None:
                wanted = set(part["buckets"]) if only is None else set(part["buckets"]) & set(only)
                if not wanted:
                    continue
                rows = rows.where(F.col("_bucket").isin(sorted(wanted)))
            have = set(rows.columns)
            rows = rows.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema],
                               (F.lit(part["run"]) if "_run" not in have else F.col("_run")).cast("long").alias("_run"))
            out = rows if out is None else out.unionByName(rows)
        empty = T.StructType([*schema.fields, T.StructField("_run", T.LongType())])
        return out if out is not None else self.spark.createDataFrame([], empty)

    def has(self, name: str) -> bool:
        return name in self.state()["tables"]

    def change(self, run: int) -> "Change | None":
        """A change to fill and commit, or None where the run is in the manifest already."""
        state = self.state()
        return None if run <= state["run"] else Change(self, state, run)

    def sweep(self) -> list[str]:
        """Removes folders of lost runs and of parts that the newest manifest no longer names; not while readers hold older ones."""
        named = {p["path"] for t in self.state()["tables"].values() for p in t["parts"]}
        gone = [f"{t}/{p}" for t in self._names(self.root) if t != "manifests" for p in self._names(f"{self.root}/{t}") if f"{t}/{p}" not in named]
        for name in gone:
            path, fs = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)
        return gone


def _with_bucket(schema: T.StructType, buckets: list[int] | None) -> T.StructType:
    return schema if buckets is None else T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])


class Change:
    """Parts written for one run; nothing of them counts before ``commit``."""

    def __init__(self, store: Store, state: dict, run: int) -> None:
        self.store, self.run = store, run
        self.state = {**state, "tables": {k: {**t, "parts": [dict(p) for p in t["parts"]]} for k, t in state["tables"].items()}, "values": dict(state["values"])}

    def _write(self, name: str, df: DataFrame, keys: list[str] | None, count: int) -> dict:
        path = f"{name}/run-{self.run:08d}-{uuid.uuid4().hex[:12]}"
        where = f"{self.store.root}/{path}"
        if keys is None:
            df.write.parquet(where)
            return {"path": path, "run": self.run, "buckets": None, "schema": df.schema.jsonValue()}
        # a bucket that is larger than a partition should be is divided by the planner
        dealt = df.withColumn("_bucket", self.store.bucket(keys, count)).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(where)
        held = sorted(int(n.split("=")[1]) for n in self.store._names(where) if n.startswith("_bucket="))
        return {"path": path, "run": self.run, "buckets": held, "schema": df.schema.jsonValue()}

    def _entry(self, name: str, keys: list[str] | None) -> dict:
        return self.state["tables"].setdefault(name, {"keys": keys, "buckets": self.store.buckets, "parts": [], "rows": 0, "schema": {"type": "struct", "fields": []}})

    def put(self, name: str, df: DataFrame, keys: list[str] | None = None) -> int:
        """Adds rows (with ``keys``: dealt into buckets); columns new to the table are null in its older parts. The number of rows."""
        entry = self._entry(name, keys)
        part = self._write(name, df, keys, entry["buckets"])
        rows = self.store.spark.read.schema(_with_bucket(df.schema, part["buckets"])).parquet(f"{self.store.root}/{part['path']}").count()
        known = {f["name"] for f in entry["schema"]["fields"]}
        entry["schema"] = {"type": "struct", "fields": [*entry["schema"]["fields"], *(f for f in part["schema"]["fields"] if f["name"] not in known)]}
        entry["rows"] += rows
        if rows:
            entry["parts"].append(part)
        return rows

    def replace(self, name: str, df: DataFrame) -> None:
        """Puts a whole table in place of the stored one."""
        self.state["tables"].pop(name, None)
        self.put(name, df)

    def set(self, name: str, value) -> None:
        self.state["values"][name] = value

    def compact(self, name: str, merge: Merge, most_parts: int = MOST_PARTS) -> list[int]:
        """Rewrites buckets with more than ``most_parts`` parts as one, or all where buckets have to double. The buckets written.

        ``merge`` gives what is left of rows with ``_run``; a column ``_run`` in its result is kept with the rows.
        """
        entry = self.state["tables"][name]
        parts = [p for p in entry["parts"] if p["buckets"] is not None]
        count = entry["buckets"]
        while entry["rows"] > self.store.bucket_rows * count:
            count *= 2
        held = [b for p in parts for b in p["buckets"]]
        crowded = sorted(set(held)) if count > entry["buckets"] else sorted({b for b in held if held.count(b) > most_parts})
        if not crowded:
            return []
        rows = merge(self.store.read(name, state=self.state, only=crowded))
        part = self._write(name, rows, entry["keys"], count)
        for p in parts:
            p["buckets"] = [b for b in p["buckets"] if b not in set(crowded)]
        entry["parts"] = [p for p in entry["parts"] if p["buckets"] is None or p["buckets"]] + [part]
        if count > entry["buckets"]:
            entry["buckets"] = count
        entry["rows"] = sum(self.store.spark.read.schema(_with_bucket(T.StructType.fromJson(p["schema"]), p["buckets"])).parquet(f"{self.store.root}/{p['path']}").where(
            F.col("_bucket").isin(p["buckets"])).count() for p in entry["parts"] if p["buckets"])
        return crowded

    def commit(self) -> None:
        self.state["version"] += 1
        self.state["run"] = self.run
        self.store._publish(self.state)


def latest(keys: list[str], stamp: str | None = None) -> Merge:
    """Of each key the row of the newest run; with ``stamp`` that column never goes back. ``_run`` stays."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, stamp)]
        kept = [F.max_by(F.struct(*rest), F.col("_run")).alias("_r"), *([F.max(stamp).alias(stamp)] if stamp else [])]
        return rows.groupBy(*keys).agg(*kept).select(*[c if c in (*keys, stamp) else F.col(f"_r.`{c}`").alias(c) for c in rows.columns])
    return merge


def current(store: Store, name: str, keys: list[str], stamp: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The keyed table as it stands; with ``wanted`` (key columns) at least the rows of those keys, read from their buckets alone."""
    return latest(keys, stamp)(store.read(name, wanted)).drop("_run")
