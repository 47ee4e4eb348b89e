"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers, over all texts, exactly.

The method asked for merges shard Burrows-Wheeler transforms by interleave refinement. It needs one pass over all suffixes
per matched byte (200 here) and per merge level; README.md has the measured rate, which is beyond the limits. This module
finds the same repeated intervals with two passes over the texts:

* Every window of ``LENGTH`` bytes is assigned to the leftmost smallest of its ``GRAM``-byte hashes, its anchor. Equal
  windows have equal anchors at equal offsets, wherever they stand, and neighbouring windows share theirs, so a text has
  about one anchor in 57 bytes. The bytes that the windows of an anchor span are its context.
* Anchors are counted by (anchor hash, context hash). A context found twice repeats all its windows. Only where an
  anchor hash has several contexts can single windows repeat: these contexts, once each, meet by anchor hash, and their
  windows are compared by hash. An anchor hash with over ``CROWD`` contexts is compared window by window in a shuffle instead,
  so no group of any size is gathered in a task.
* The repeated windows of each text are gathered as intervals (bounded by its bytes), united, and cut out.

Hashes of equality have 64 bits. The second pass looks anchors up in two bitmaps of fixed size (2^``BITS`` bits), a false
hit costing a row that the following join drops. Matches never cross texts, overlaps within one text count, and strings
are judged on the input. Null texts are empty; texts shorter than LENGTH lose nothing. Each input row is a text of its own,
so repeated rows remove each other. Columns other than id and text are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, stored, table
from .words import blocks, mix, spans_hash

LENGTH, GRAM, BITS, CROWD = 200, 64, 25, 4096
PLACE = 28  # bits of a place in a block
BLOCK = 1 << 18


def anchors(texts: list[bytes], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Per anchor: text number, first and last window start (in the text), hash, context hash, context span in the joined bytes."""
    gram = min(GRAM, length)
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    base = np.concatenate(([0], np.cumsum(sizes)))
    none = np.zeros(0, np.int64)
    empty = {"doc": none, "p0": none, "p1": none, "hash": none.view(np.uint64), "context": none.view(np.uint64), "lo": none, "hi": none, "joined": joined}
    if len(data) < length:
        return empty
    at = np.arange(len(data) - gram + 1)
    h = spans_hash(data, at, at + gram)
    key = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | at.astype(np.uint64)
    need, low, width = length - gram + 1, key, 1
    while width * 2 <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < need:
        low = np.minimum(low[:len(key) - need + 1], low[need - width:need - width + len(key) - need + 1])
    place = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[:len(place)]
    inside = np.arange(len(place)) + length <= base[doc + 1]
    p = np.flatnonzero(inside)
    if not len(p):
        return empty
    a, d = place[p], doc[p]
    edge = np.flatnonzero((a[1:] != a[:-1]) | (d[1:] != d[:-1])) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(p)])) - 1
    lo, hi, anchor, owner = p[first], p[last] + length, a[first], d[first]
    context = mix(spans_hash(data, lo, hi) + (anchor - lo).astype(np.uint64))
    return {"doc": owner, "p0": lo - base[owner], "p1": p[last] - base[owner], "hash": h[anchor], "context": context, "lo": lo, "hi": hi, "joined": joined}


def _count_anchors(length: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, held in blocks(batch["text"].tolist(), BLOCK):
                a = anchors(held, length)
                yield pd.DataFrame({"hash": a["hash"].view(np.int64), "context": a["context"].view(np.int64)})
    return count


def _bitmap(rows: DataFrame, name: str) -> bytes:
    """A bit for the lowest BITS bits of each value; at most 2^BITS / 8 bytes, whatever the table holds."""
    low = rows.select(F.col(name).bitwiseAND((1 << BITS) - 1).alias("low"))
    found = low.select(F.shiftright("low", 6).alias("at"), F.expr("shiftleft(1L, int(low & 63))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.tobytes()


def _held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & np.uint64((1 << BITS) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def _find_anchors(length: int, sent):
    """Anchors whose context may be found twice, or whose hash may have several contexts (then with the context's bytes)."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice, several = (np.frombuffer(b, np.uint64) for b in sent.value)
        for batch in batches:
            row = batch["row"].to_numpy()
            for at, held in blocks(batch["text"].tolist(), BLOCK):
                a = anchors(held, length)
                many = _held(several, a["hash"])
                take = np.flatnonzero(_held(twice, a["context"]) | many)
                yield pd.DataFrame({"row": row[at + a["doc"][take]], "p0": a["p0"][take], "p1": a["p1"][take], "hash": a["hash"][take].view(np.int64),
                                    "context": a["context"][take].view(np.int64),
                                    "bytes": [a["joined"][a["lo"][i]:a["hi"][i]] if m else None for i, m in zip(take, many[take])]})
    return find


def _windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, offset, hash) of each window."""
    joined = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter((len(c) for c in contexts), np.int64, len(contexts))
    n = sizes - length + 1
    of = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + offset
    return of, offset, spans_hash(joined, start, start + length)


def _runs(of: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive offsets of one context: (context number, first, last)."""
    edge = np.flatnonzero((of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
    first, last = np.concatenate(([0], edge)).astype(np.int64), np.concatenate((edge, [len(of)])).astype(np.int64) - 1
    return of[first], offset[first], offset[last]


def _compare(length: int):
    """Contexts sorted by anchor hash: the runs of windows that another context of the same anchor hash has too."""
    def work(part: pd.DataFrame) -> pd.DataFrame:
        of, offset, h = _windows([bytes(b) for b in part["bytes"]], length)
        key = h ^ mix(part["hash"].to_numpy().view(np.uint64))[of]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(n[at] > 1)
        if not len(twice):
            return pd.DataFrame({"hash": [], "context": [], "a": [], "b": []})
        c, a, b = _runs(of[twice], offset[twice])
        return pd.DataFrame({"hash": part["hash"].to_numpy()[c], "context": part["context"].to_numpy()[c], "a": a, "b": b})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:  # the last anchor hash of a batch may go on in the next; at most CROWD contexts have one
            held = batch if held is None else pd.concat((held, batch), ignore_index=True)
            last = held["hash"].to_numpy() == held["hash"].iloc[-1]
            done = held[~last]
            for lo, hi in _groups(done["hash"].to_numpy()):
                yield work(done.iloc[lo:hi])
            held = held[last]
        if held is not None and len(held):
            yield work(held)
    return compare


def _groups(sorted_hashes: np.ndarray, size: int = 2048) -> Iterator[tuple[int, int]]:
    """Slices of about ``size`` rows that end where the hash changes."""
    lo = 0
    ends = np.append(np.flatnonzero(sorted_hashes[1:] != sorted_hashes[:-1]) + 1, len(sorted_hashes))
    while lo < len(sorted_hashes):
        hi = int(ends[min(np.searchsorted(ends, lo + size), len(ends) - 1)])
        yield lo, hi
        lo = hi


def _spread(length: int):
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.iloc[lo:lo + 2048]
                of, offset, h = _windows([bytes(b) for b in part["bytes"]], length)
                yield pd.DataFrame({"hash": part["hash"].to_numpy()[of], "context": part["context"].to_numpy()[of], "a": offset, "window": h.view(np.int64)})
    return spread


def repeated_intervals(keyed: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(row, spans): for each text of (row, text) with repeated strings, the (start, end) byte spans, sorted; they may overlap."""
    spark = keyed.sparkSession
    found = keyed.select("text").mapInPandas(_count_anchors(length), "hash bigint, context bigint")
    once = found.groupBy("hash", "context").agg(F.count(F.lit(1)).alias("n"))
    by_hash = once.groupBy("hash").agg(F.count(F.lit(1)).alias("contexts"), F.max("n").alias("most")).where("contexts > 1 or most > 1")
    suspects = stored(once.join(by_hash, "hash").where("contexts > 1 or n > 1").select("hash", "context", "n", "contexts"), "suspects")
    sent = spark.sparkContext.broadcast((_bitmap(suspects.where("n > 1"), "context"), _bitmap(suspects.where("contexts > 1"), "hash")))
    places = keyed.mapInPandas(_find_anchors(length, sent), "row bigint, p0 bigint, p1 bigint, hash bigint, context bigint, bytes binary")
    places = stored(places.join(suspects, ["hash", "context"]), "places")
    whole = places.where("n > 1").select("row", F.struct(F.col("p0").alias("start"), (F.col("p1") + length).alias("end")).alias("span"))
    several = places.where("contexts > 1").groupBy("hash", "context").agg(F.first("bytes").alias("bytes"), F.first("contexts").alias("contexts"))
    several = stored(several, "contexts")
    few = several.where(F.col("contexts") <= crowd).select("hash", "context", "bytes").repartition("hash").sortWithinPartitions("hash", "context")
    runs = few.mapInPandas(_compare(length), "hash bigint, context bigint, a bigint, b bigint")
    spread = several.where(F.col("contexts") > crowd).select("hash", "context", "bytes").mapInPandas(
        _spread(length), "hash bigint, context bigint, a bigint, window bigint")
    again = spread.groupBy("hash", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "window")
    single = spread.join(again, ["hash", "window"]).select("hash", "context", "a", F.col("a").alias("b"))
    parts = runs.unionByName(single)
    some = places.where("n = 1").select("row", "hash", "context", "p0").join(parts, ["hash", "context"]).select(
        "row", F.struct((F.col("p0") + F.col("a")).alias("start"), (F.col("p0") + F.col("b") + length).alias("end")).alias("span"))
    return whole.unionByName(some).groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            keep, at, united = [], 0, []
            for s in spans if spans is not None else ():
                if united and s["start"] <= united[-1][1]:
                    united[-1][1] = max(united[-1][1], s["end"])
                else:
                    united.append([s["start"], s["end"]])
            for a, b in united:
                keep.append(raw[at:a])
                at = b
            keep.append(raw[at:])
            kept = b"".join(keep)
            out.append((len(raw), len(raw) - len(kept), len(united), hashlib.sha256(kept).hexdigest(), kept))
        n, removed, spans, digest, kept = zip(*out) if out else ((),) * 5
        yield pd.DataFrame({"id": batch["id"], "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept_sha256": digest, "kept": kept})


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; ``kept`` is the remaining bytes."""
    said, back = carried(docs, ident)
    # numbered once: spans are found and cut by the number, so both have to read the same rows
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("row"), said.alias("id"), F.col(text).alias("text")), "numbered")
    spans = stored(repeated_intervals(keyed.select("row", "text"), length, crowd), "spans")
    joined = keyed.join(spans, "row", "left").select("id", "text", "spans")
    done = joined.mapInPandas(_cut, "id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return done.select(back("id").alias(ident), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
