"""Near-duplicate texts by HyperMinHash.

A text's set is its distinct word shingles (a text of fewer words, but not none, is one shingle). Its sketch has
``BUCKETS`` registers of 16 bits: the smallest hash of the bucket as leading-zero count and ``MANTISSA`` bits; empty buckets
borrow. Texts with equal sets are one class, named by its smallest id. ``BANDS`` bands of ``ROWS`` registers are the candidate
keys; a pair goes on if sizes allow the similarity and the estimate, corrected for register collisions, is not far below
it; it links only if the full sets reach it. At a similarity of 0.8 a pair misses all bands with a chance of about 1e-5;
small sets borrow most registers from few, so there it is more (simulated: 11 of 64,000 pairs of 4 and 5 shingles, 3 of 64,000 at
8 and 10, 9 and 9, 18 and 18, 1 of 48,000 at 40).

No bucket is paired with itself. Each bucket first links its members to the one that shares most bands with others, the
likely origin of a group of copies. Where members of a bucket are then still in several components, every member outside
the bucket's largest component meets the members of other components, and only these, with sizes, parity bits of the sets
(which bound their difference from below, so they lose nothing) and, for sets that fill most registers themselves, one bit
per register as part of the join condition. So no pair of candidates in different components stays untested, whatever the size of a bucket.

Full sets are read for candidate texts only, as 48 bits per shingle. Results of each phase are written to the shared
folder, so a lost executor costs a task, not the job.

Null and empty texts have no shingle, link with nothing and are kept. Each input row gives one output row; ids are
expected to be distinct (rows that repeat an id share its component). Columns other than id and text are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import carried, stored, table
from .line_dedup import in_bitmap
from .words import WHITE_LOWER, Words, blocks, mix

BUCKETS, BANDS, ROWS, MANTISSA = 256, 64, 8, 10
BUCKET_BITS = BUCKETS.bit_length() - 1
#: bits that hold how often, odd or even, the elements of a set fall on them
PARITY = 1024
SLACK = 0.15  # six standard deviations of the estimate at a similarity of 0.8
#: registers of smaller sets are mostly copies of others and differ together: no test of their bits, and none of the estimate
BITS_FROM, ESTIMATE_FROM = BUCKETS, 32
_order = mix(np.arange(BUCKETS * BUCKETS, dtype=np.uint64)).reshape(BUCKETS, BUCKETS)
#: the order in which an empty bucket borrows from others, and the place of each bucket in it
PROBES = np.argsort(_order, axis=1)
PLACES = np.argsort(PROBES, axis=1)
#: which registers make up a band: each stands in two of them, in other company
_members = np.concatenate([np.argsort(mix(np.arange(BUCKETS, dtype=np.uint64) + np.uint64(1000 * (k + 1)))) for k in range(BANDS * ROWS // BUCKETS)])
MEMBERS = _members.reshape(BANDS, ROWS)


def distinct_shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct shingles of each text of a block."""
    grams, of = w.shingles(n)
    salt = mix(of.astype(np.uint64) + np.uint64(1))
    key, at = np.unique(grams ^ salt, return_index=True)
    at.sort()
    return grams[at], of[at]


def registers(grams: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n rows of BUCKETS registers; only an empty set has empty (0) ones."""
    least = np.full(n * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    h = mix(grams)
    np.minimum.at(least, of * BUCKETS + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), (h << np.uint64(BUCKET_BITS)) | np.uint64(1))
    zeros = 64 - np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    value = (zeros << np.uint64(MANTISSA)) + mantissa + np.uint64(1)
    return _filled(np.where(least == np.iinfo(np.uint64).max, 0, value).astype(np.uint16).reshape(n, BUCKETS))


def parities(grams: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n rows of PARITY bits; each element of a set turns one of them, so two sets differ in at least as many elements as bits."""
    at, times = np.unique(of * PARITY + (grams & np.uint64(PARITY - 1)).astype(np.int64), return_counts=True)
    bits = np.zeros(n * PARITY, np.uint8)
    bits[at[times % 2 == 1]] = 1
    return np.packbits(bits.reshape(n, PARITY), axis=1).view(np.int64)


def _filled(reg: np.ndarray) -> np.ndarray:
    """Empty buckets borrow from the first filled one in their own order, so small sets agree as often as large ones."""
    out, held = reg.copy(), reg > 0
    count = held.sum(1)
    for d in np.flatnonzero((count > 0) & (count <= 32)):
        have = np.flatnonzero(held[d])
        out[d] = reg[d, have[np.argmin(PLACES[:, have], axis=1)]]
        out[d, have] = reg[d, have]
    row, bucket = np.nonzero(~held & (count > 32)[:, None])
    for t in range(BUCKETS):
        if not len(row):
            break
        source = PROBES[bucket, t]
        hit = held[row, source]
        out[row[hit], bucket[hit]] = reg[row[hit], source[hit]]
        row, bucket = row[~hit], bucket[~hit]
    return out


def _chance_table() -> np.ndarray:
    """The chance that two unrelated registers agree, by the binary logarithm of the shingles per bucket (-8 to 24)."""
    zeros = np.arange(0, 40)[:, None]
    step = np.arange(1 << MANTISSA)[None, :]
    low = 2.0 ** -(zeros + 1) * (1 + step / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    out = []
    for e in range(-8, 25):
        size = 2.0 ** e
        cell = np.exp(-size * low) - np.exp(-size * high)
        out.append(float((cell ** 2).sum() / max((1 - np.exp(-size)) ** 2, 1e-12)))
    return np.clip(out, 0, 0.9)


CHANCE = _chance_table()


def estimate(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, without the agreement that chance gives."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1)
    at = np.clip(np.round(np.log2(np.maximum(sizes, BUCKETS) / BUCKETS)) + 8, 0, len(CHANCE) - 1).astype(int)
    return (same - CHANCE[at]) / (1 - CHANCE[at])


def sketches(docs: DataFrame, ident: str, text: str, words: int) -> DataFrame:
    """(id, n, sum, xor, registers) per row; sum and xor of the set's hashes name its class."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, held in blocks(batch["text"].tolist()):
                grams, of = distinct_shingles(Words(held, WHITE_LOWER), words)
                n = np.bincount(of, minlength=len(held))
                first = np.concatenate(([0], np.cumsum(n)))
                total = np.concatenate(([np.uint64(0)], np.cumsum(mix(grams))))
                parity = np.zeros(len(held), np.uint64)
                if len(grams):
                    parity[n > 0] = np.bitwise_xor.reduceat(mix(grams + np.uint64(7)), first[:-1][n > 0])
                reg = registers(grams, of, len(held))
                yield pd.DataFrame({"id": batch["id"].iloc[at:at + len(held)], "n": n, "sum": (total[first[1:]] - total[first[:-1]]).view(np.int64),
                                    "xor": parity.view(np.int64), "registers": [r.tobytes() for r in reg],
                                    "bits": list(np.packbits(reg & 1, axis=1).view(np.int64)), "parity": list(parities(mix(grams), of, len(held)))})
    said, back = carried(docs, ident)
    return docs.select(said.alias("id"), F.col(text).alias("text")).mapInPandas(
        make, "id string, n bigint, sum bigint, xor bigint, registers binary, bits array<bigint>, parity array<bigint>").withColumn("id", back("id"))


def bands(classes: DataFrame) -> DataFrame:
    """(key, id) for each band."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo:lo + 1000]
                reg = np.frombuffer(b"".join(part["registers"]), np.uint16).reshape(len(part), BUCKETS).astype(np.uint64)[:, MEMBERS]
                key = reduce(lambda acc, k: mix(acc ^ reg[:, :, k]), range(ROWS), np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), reg.shape[:2]))
                yield pd.DataFrame({"key": key.reshape(-1).view(np.int64), "id": np.repeat(part["id"].to_numpy(), BANDS)})
    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "registers").mapInPandas(cut, f"key bigint, id {kind}")


def _bits_fit(a: Column, b: Column, percent: int) -> Column:
    """Unequal registers differ in their lowest bit half the time: six standard deviations over what a link would show."""
    part = (100 - percent) / 200
    most = BUCKETS * part + 6 * (BUCKETS * part * (1 - part)) ** 0.5
    differ = reduce(lambda acc, k: acc + F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))), range(BUCKETS // 64), F.lit(0))
    return differ <= int(most)


def _parity_fits(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    """Sets that reach the similarity differ in at most this share of their elements, and so of their parity bits: no link is lost."""
    differ = reduce(lambda acc, k: acc + F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))), range(PARITY // 64), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def _close(least: float):
    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        left = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), BUCKETS)
        right = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), BUCKETS)
        small = np.minimum(n.to_numpy(), m.to_numpy()) < ESTIMATE_FROM
        return pd.Series(small | (estimate(left, right, (n.to_numpy() + m.to_numpy()) / 2) >= least))
    return close


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among the ids: a bitmap of fixed size spares the others the shuffle of a join that follows."""
    return in_bitmap(rows.withColumn("key", F.xxhash64("id")), ids.select(F.xxhash64("id").alias("key"))).drop("key")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and estimate allow a link."""
    met = _among(classes, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    one = met.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"))
    two = met.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"))
    both = pairs.join(one, "a").join(two, (pairs["b"] == two["b"]) & _sizes_fit(F.col("n_a"), F.col("n_b"), percent)).drop(pairs["b"])
    return both.where(_close(percent / 100 - SLACK)("r_a", "r_b", "n_a", "n_b")).select("a", "b")


def _sets(docs: DataFrame, ident: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(id, set): sorted 48-bit hashes of the shingles of the wanted texts."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, held in blocks(batch["text"].tolist()):
                grams, of = distinct_shingles(Words(held, WHITE_LOWER), words)
                first = np.searchsorted(of, np.arange(len(held) + 1))
                out = [np.unique(grams[first[d]:first[d + 1]] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for d in range(len(held))]
                yield pd.DataFrame({"id": batch["id"].iloc[at:at + len(held)], "set": out})
    kind = docs.schema[ident].dataType.simpleString()
    # wanted ids are distinct; a semi join would be pushed below the bitmap and shuffle every text
    rows = _among(docs.select(F.col(ident).alias("id"), F.col(text).alias("text")), wanted).join(wanted, "id")
    return rows.mapInPandas(make, f"id {kind}, set binary")


def _linked(percent: int):
    def whole(b: bytes) -> np.ndarray:
        out = np.zeros((len(b) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
        return out.view(np.uint64)[:, 0]

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = whole(x), whole(y)
            shared = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
            out.append(100 * shared >= percent * (len(p) + len(q) - shared))
        return pd.Series(out, dtype=bool)
    return linked


def _verified(pairs: DataFrame, docs: DataFrame, ident: str, text: str, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(_sets(docs, ident, text, words, wanted), "sets").groupBy("id").agg(F.first("set").alias("set"))
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("s_a"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("s_b"))
    return pairs.join(one, "a").join(two, "b").where(_linked(percent)("s_a", "s_b")).select("a", "b")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: the smallest id reachable over links of at least ``percent`` similarity."""
    made = stored(sketches(docs, ident, text, words), "sketches")
    classes = stored(made.where("n > 0 and id is not null").groupBy("sum", "xor", "n").agg(F.min("id").alias("id"), F.first(F.struct("registers", "bits", "parity")).alias("s"))
                     .select("id", "n", "s.registers", "s.bits", "s.parity", "sum", "xor"), "classes")
    keyed = bands(classes)
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(keyed.join(many, "key"), "buckets")
    weight = shared.groupBy("id").agg(F.sum("members").alias("weight"))
    lead = shared.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("a"))
    stars = shared.join(lead, "key").where("a != id").select("a", F.col("id").alias("b")).distinct()
    links = stored(_verified(stored(_likely(stars, classes, percent), "stars"), docs, ident, text, words, percent), "links")
    labels = _labels(links)
    # buckets whose members are still in several components
    placed = shared.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_keys = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest")).where("parts > 1")
    unsettled = stored(placed.join(open_keys.select("key", "largest"), "key"), "unsettled")
    still = stored(unsettled.join(_among(classes.select("id", F.col("n").alias("size"), "bits", "parity"), unsettled), "id"), "open")
    here = still.where("component != largest").select("key", F.col("id").alias("a"), F.col("component").alias("c_a"), F.col("size").alias("n_a"), F.col("bits").alias("bits_a"), F.col("parity").alias("par_a"), "largest")
    there = still.select("key", F.col("id").alias("b"), F.col("component").alias("c_b"), F.col("size").alias("n_b"), F.col("bits").alias("bits_b"), F.col("parity").alias("par_b"))
    # two outsiders meet once; an outsider meets all of the largest component
    meet = here.join(there, (here["key"] == there["key"]) & (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("largest")) | (F.col("a") < F.col("b")))
                     & _sizes_fit(F.col("n_a"), F.col("n_b"), percent) & _parity_fits(F.col("par_a"), F.col("par_b"), F.col("n_a"), F.col("n_b"), percent)
                     & ((F.least("n_a", "n_b") < BITS_FROM) | _bits_fit(F.col("bits_a"), F.col("bits_b"), percent))).select("a", "b").distinct()
    # pairs that were tested as stars and failed need no second test
    rest = stored(_likely(meet.join(stars, ["a", "b"], "left_anti"), classes, percent), "rest")
    more = stored(_verified(rest, docs, ident, text, words, percent), "more-links")
    labels = _labels(links.unionByName(more)) if more.limit(1).count() else labels
    named = classes.select("sum", "xor", "n", "id").join(labels, "id", "left").select("sum", "xor", "n", F.coalesce("component", "id").alias("component"))
    out = made.join(named, ["sum", "xor", "n"], "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _labels(links: DataFrame) -> DataFrame:
    return components(links, "a", "b")


def op8_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM
  (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, g FROM s SEMI JOIN k USING (g)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT doc_id AS a, doc_id AS m FROM d UNION SELECT e.b, t.m FROM t JOIN e ON e.a = t.a WHERE t.m < e.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(m) AS component_id, d.doc_id = min(m) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN t ON t.a = d.doc_id GROUP BY d.doc_id, n
"""
