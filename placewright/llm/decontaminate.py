"""Benchmark decontamination: a prefix-filtered containment join between texts and windows of benchmark items.

An item is cut into windows of ten consecutive words (an item of fewer words, but not none, is one window). A window is
contained in a text only if all its five-word shingles occur there, so one necessary shingle, the rarest over all
documents, is its whole prefix. A window of fewer than five words is its own shingle; texts are also cut into runs of each
such length that the benchmark has (four at most). Documents are joined on those shingles alone; length and position bounds and the exact
comparison of the window's words are part of the join, which therefore puts out true occurrences only.

Two passes over the documents: shingle frequencies, then candidates. Both look shingles up in a bitmap of fixed size
(``BITS``), whatever the benchmark holds; a false hit costs a row, never a result. The join itself is left to Spark,
which broadcasts the windows only if they are measured to be small. Hit positions are gathered per document, so their
number is bounded by its words.

Words: A-Z lower-cased, maximal runs of ASCII letters, digits and characters beyond ASCII. Null and empty texts have no
words; an item without words has no window; an empty benchmark hits nothing. A null item id counts as the empty string.
Each input row gives one output row, repeated rows included; columns other than id and text are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, stored, table
from .words import ALNUM_LOWER, Words, blocks, shingles

WINDOW, SHINGLE, BITS = 10, 5, 23


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, shingles): every window with the hashes of its shingles in order."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, held in blocks(batch["text"].tolist()):
                w = Words(held, ALNUM_LOWER)
                for d in range(len(held)):
                    lo, hi = int(w.first[d]), int(w.first[d + 1])
                    for a in range(lo, max(lo + (hi > lo), hi - WINDOW + 1)):
                        b = min(a + WINDOW, hi)
                        own = np.array([0, b - a])
                        grams, _ = shingles(w.hash[a:b], own, np.zeros(b - a, np.int64), SHINGLE)
                        out.append((batch["item"].iloc[at + d], [w.word(i).decode("utf-8", "replace") for i in range(a, b)], grams.view(np.int64)))
            yield pd.DataFrame(out, columns=["item", "words", "shingles"])
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInPandas(cut, "item string, words array<string>, shingles array<bigint>").dropDuplicates(["item", "words"])


def bitmap(hashes: DataFrame, name: str) -> np.ndarray:
    """A bit for each value of the lowest BITS bits that occurs; 2^BITS / 8 bytes at most, whatever the table holds."""
    low = hashes.select(F.col(name).bitwiseAND((1 << BITS) - 1).alias("low"))
    found = (low.select(F.shiftright("low", 6).alias("at"), F.expr("shiftleft(1L, int(low & 63))").alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect())
    out = np.zeros(1 << (BITS - 6), np.int64)
    for at, bits in found:
        out[at] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def short_sizes(windows: DataFrame) -> list[int]:
    """The word numbers below SHINGLE that windows have."""
    found = windows.select(F.size("words").alias("n")).where(F.col("n") < SHINGLE).distinct().collect()
    return sorted(r.n for r in found)


def text_shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place) of each run of that many words; texts of fewer words have none."""
    grams, of = w.shingles(size)
    pos = np.arange(len(of)) - np.searchsorted(of, np.arange(len(w.counts)))[of]  # shingles of a text stand together, in order
    whole = w.counts[of] >= size
    return grams[whole], of[whole], pos[whole]


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def shingle_counts(docs: DataFrame, text: str, wanted: np.ndarray, short: list[int]) -> DataFrame:
    """(shingle, n): how often each wanted shingle occurs in all texts, combined per block before the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(_packed(wanted))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for _, held in blocks(batch["text"].tolist()):
                w = Words(held, ALNUM_LOWER)
                grams = np.concatenate([g[bits[g & np.uint64((1 << BITS) - 1)]] for g, _, _ in (text_shingles(w, n) for n in [*short, SHINGLE])])
                values, n = np.unique(grams, return_counts=True)
                yield pd.DataFrame({"shingle": values.view(np.int64), "n": n})
    return docs.select(F.col(text).alias("text")).mapInPandas(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def window_prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, offset, item, words): the rarest shingle of each window; windows with a shingle that no text has are gone."""
    each = windows.select("item", "words", F.size("shingles").alias("all"), F.posexplode("shingles").alias("offset", "shingle"))
    known = each.join(counts, "shingle")
    best = known.groupBy("item", "words").agg(F.count(F.lit(1)).alias("seen"), F.first("all").alias("all"),
                                              F.min(F.struct("n", "shingle", "offset")).alias("best"))
    return best.where("seen = all").select(F.col("best.shingle").alias("shingle"), F.col("best.offset").alias("offset"), "item", "words")


def _candidates(docs: DataFrame, ident: str, text: str, wanted: np.ndarray, short: list[int]) -> DataFrame:
    """(row, id, n_words, c): each text with its places that hold a wanted shingle and the words around them.

    A shingle of fewer than SHINGLE words is a whole window, so it stands alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_packed(wanted))
    lead = WINDOW - 1

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            for at, held in blocks(batch["text"].tolist()):
                w = Words(held, ALNUM_LOWER)
                found: list[list[dict]] = [[] for _ in held]
                for size in [*short, SHINGLE]:
                    grams, of, at_word = text_shingles(w, size)
                    for k in np.flatnonzero(bits[grams & np.uint64((1 << BITS) - 1)]):
                        d = int(of[k])
                        pos, lo, hi = int(at_word[k]), int(w.first[d]), int(w.first[d + 1])
                        a, b = (max(lo, lo + pos - lead), min(hi, lo + pos + WINDOW)) if size == SHINGLE else (lo + pos, lo + pos + size)
                        found[d].append({"shingle": int(grams[k].view(np.int64)), "pos": pos, "before": lo + pos - a,
                                         "near": [w.word(i).decode("utf-8", "replace") for i in range(a, b)]})
                part = batch.iloc[at:at + len(held)]
                yield pd.DataFrame({"row": part["row"], "id": part["id"], "n_words": w.counts, "c": found})
    said, back = carried(docs, ident)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), said.alias("id"), F.col(text).alias("text"))
    found = rows.mapInPandas(find, "row bigint, id string, n_words bigint, c array<struct<shingle:bigint,pos:int,before:int,near:array<string>>>")
    return found.withColumn("id", back("id"))


def covered(spans: Column) -> Column:
    """How many words the (start, end) spans cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc.end, s.end).alias("end"),
                                   (acc.n + F.greatest(s.end - F.greatest(acc.end, s.start), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc.n)


def contamination(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row per text: id, n_words, ``spans`` of hit words, ``items`` (sorted ids of items with an occurring window)."""
    windows = stored(item_windows(items, item, item_text), "windows")
    counts = shingle_counts(docs, text, bitmap(windows.select(F.explode("shingles").alias("s")), "s"), short_sizes(windows))
    prefixes = stored(window_prefixes(windows, counts), "prefixes")
    rows = _candidates(docs, ident, text, bitmap(prefixes, "shingle"), short_sizes(prefixes))
    each = rows.select("row", "id", "n_words", F.explode_outer("c").alias("c")).select("row", "id", "n_words", "c.*")
    start, width = F.col("before") - F.col("offset"), F.size("words")
    fits = (each["shingle"] == prefixes["shingle"]) & (start >= 0) & (start + width <= F.size("near")) & (
        F.slice("near", F.greatest(start + 1, F.lit(1)), width) == F.col("words"))
    hits = each.join(prefixes, fits, "left").drop(prefixes["shingle"])
    span = F.struct((F.col("pos") - F.col("offset")).alias("start"), (F.col("pos") - F.col("offset") + width).alias("end"))
    return hits.groupBy("row").agg(F.first("id").alias(ident), F.first("n_words").alias("n_words"),
                                   F.collect_set(F.when(F.col("item").isNotNull(), span)).alias("spans"),
                                   F.array_sort(F.collect_set("item")).alias("items")).drop("row")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", covered(F.col("spans")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS win
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM iw) WHERE len(w) >= width)),
h AS (SELECT doc_id, i, dw.width, item_id FROM dw JOIN iw USING (width, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
