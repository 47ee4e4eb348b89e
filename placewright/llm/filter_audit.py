"""Audit of how filters overlap: sorted posting lists of failing ids, merged by galloping.

For each part and range of ``RANGE`` ids a row of ``posting_lists`` holds the sorted ids that fail each filter, and those with each
label. Of every set of earlier filters the union of lists is merged from a smaller union, and what a filter removes after them is
the difference of its list: the shorter list gallops through the longer one (binary search from the last hit on). Sizes are
added over the ranges of a part, and the orders in which the filters can run only look these sums up, as an order
matters by the set that ran before. So the work for any number of orders is 2^n unions of lists.

Ids are numbers of the stored rows, so null and repeated ``doc_id`` count like others, and no part or range is larger than
``RANGE``, whatever share of the rows a part has. Copies are told by a 128-bit hash of the text: of each text the rows that
have the smallest ``doc_id`` pass, found by a join on id and hash rather than on the hash alone, so a text that a third of all
rows share is no hot key. Null ids are smaller than none and fail nothing by it. Null texts are empty. A document is good or toxic if any of
its label rows says so; documents without labels are neither. Empty tables give empty results; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .words import WHITE, Words, blocks

RANGE = 1 << 16
#: least words, least percent of distinct words, most percent of capitals, characters not allowed (fixed values of the audit)
LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
FILTERS, LABELS = "ABCDE", ("good", "toxic")


def _marks(held: list[bytes]) -> list[np.ndarray]:
    """Which texts of a block fail A to D."""
    w = Words(held, WHITE)
    n = w.counts
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[fresh], minlength=len(held))
    total = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[w.bounds])
    capitals = total((w.data >= 65) & (w.data <= 90))
    points = total((w.data & 0xC0) != 0x80) - 1  # without the blank that divides texts
    symbols = total(np.isin(w.data, np.frombuffer(SYMBOLS, np.uint8)))
    return [n < LEAST_WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * points, symbols > 0]


def judged(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, A, B, C, D, E, good, toxic): each row's failures and labels, with its number as id."""
    kind = docs.schema[ident].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in blocks(batch["text"].to_pylist()):
                some = batch.slice(at, len(held))
                sums = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in held], pa.binary())
                yield pa.RecordBatch.from_arrays([some["doc"], some["part"], *[pa.array(m) for m in _marks(held)], sums],
                                                 ["doc", "part", *FILTERS[:4], "h"])
    said = docs.select(F.col(ident).alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    read_rows = said.mapInArrow(read, f"doc {kind}, part string, A boolean, B boolean, C boolean, D boolean, h binary")
    rows = stored(read_rows.select(F.monotonically_increasing_id().alias("id"), "*"), "judged")
    firsts = rows.groupBy("h").agg(F.min("doc").alias("doc")).select("doc", "h", F.lit(True).alias("first"))
    told = labels.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("doc")).agg(
        F.max((F.col("quality") == 1)).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.join(firsts, ["doc", "h"], "left").join(told, "doc", "left")
    return known.select("id", "part", *FILTERS[:4], (F.col("doc").isNotNull() & F.col("first").isNull()).alias("E"),
                        *[F.coalesce(c, F.lit(False)).alias(c) for c in LABELS])


def posting_lists(rows: DataFrame, filters: str = FILTERS, marks: tuple[str, ...] = LABELS, width: int = RANGE) -> DataFrame:
    """(part, range, n, and for each filter and label the sorted ids): one row per part and range of ids."""
    ids = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("id")))).alias(c)
    return rows.groupBy("part", F.expr(f"id div {width}").alias("range")).agg(F.count(F.lit(1)).alias("n"), *[ids(c) for c in (*filters, *marks)])


def _found(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted ids in a longer sorted list, and which of them stand there."""
    at = np.searchsorted(long, short)
    return at, (long[np.minimum(at, len(long) - 1)] == short) if len(long) else np.zeros(len(short), bool)


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Merge of sorted lists without repeats, the shortest ones first, each galloping through what is merged."""
    def two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        at, there = _found(short, long)
        return np.insert(long, at[~there], short[~there])
    return reduce(two, sorted(lists, key=len), np.zeros(0, np.int64))


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted ids of a that are not in b."""
    if len(a) <= len(b):
        return a[~_found(a, b)[1]]
    at, there = _found(b, a)
    return np.delete(a, at[there])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many ids two sorted lists share."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return int(_found(short, long)[1].sum())


def merged_sizes(lists: DataFrame, filters: str = FILTERS, marks: tuple[str, ...] = LABELS) -> DataFrame:
    """(part, filter, before, n, failing, removed, lost): for each filter and set of earlier ones (``before``, a bit each), sizes of the
    part, of the filter's list, of its difference from their union, and of what of that bears each label; a sum over ranges."""
    count = len(filters)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                part, n = batch["part"][row].as_py(), batch["n"][row].as_py()
                held = [batch[f][row].values.to_numpy() for f in filters]
                said = [batch[m][row].values.to_numpy() for m in marks]
                unions = {0: np.zeros(0, np.int64)}
                for before in range(1, 1 << count):
                    top = before.bit_length() - 1
                    unions[before] = union([unions[before ^ (1 << top)], held[top]])
                for f in range(count):
                    for before in range(1 << count):
                        if not before >> f & 1:
                            gone = difference(held[f], unions[before])
                            out.append((part, filters[f], before, n, len(held[f]), len(gone), len(unions[before]), [shared(gone, m) for m in said]))
            names = ["part", "filter", "before", "n", "failing", "removed", "earlier", "lost"]
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names)
    made = lists.drop("range").mapInArrow(sizes, "part string, filter string, before int, n bigint, failing bigint, removed bigint, earlier bigint, lost array<bigint>")
    return made.groupBy("part", "filter", "before").agg(
        *[F.sum(c).alias(c) for c in ("n", "failing", "removed", "earlier")], *[F.sum(F.get("lost", F.lit(i))).alias(f"{m}_lost") for i, m in enumerate(marks)])


def audit(sizes: DataFrame, filters: str = FILTERS, marks: tuple[str, ...] = LABELS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, a column per label, shapley): a row per part, order and step.

    The sums of a part are a row per filter and set of filters, whatever the table holds; orders are joined to them.
    """
    count = len(filters)
    orders = [("".join(o), i + 1, o[i], sum(1 << filters.index(x) for x in o[:i])) for o in permutations(filters) for i in range(count)]
    spark = sizes.sparkSession
    plan = spark.createDataFrame(orders, "filter_order string, step int, filter string, before int")
    # an order has its filter after a given set in as many ways as the set and the rest can be arranged
    ways: Column = F.get(F.array(*[F.lit(factorial(s) * factorial(count - 1 - s)) for s in range(count)]), F.bit_count("before"))
    others = F.expr(f"{(1 << count) - 1} - shiftleft(1, instr('{filters}', filter) - 1)")
    whole = sizes.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"),
                                                F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"))
    out = sizes.join(F.broadcast(plan), ["filter", "before"]).join(whole, ["part", "filter"])
    return out.select("part", "filter_order", "step", (F.col("n") - F.col("earlier") - F.col("removed")).alias("kept"), "removed",
                      (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{m}_lost" for m in marks], "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(stored(merged_sizes(posting_lists(rows)), "sizes"))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS m FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id IS NOT NULL AND doc_id > m] AS b
  FROM x LEFT JOIN l USING (doc_id)),
c AS (SELECT part, list_sum([CASE WHEN b[i] THEN (1 << (i - 1)) ELSE 0 END FOR i IN range(1, 6)])::INT AS mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY ALL),
k AS (SELECT unnest(range(0, 5))::INT AS i),
p AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM k a, k b, k c, k d, k e WHERE (1 << a.i) + (1 << b.i) + (1 << c.i) + (1 << d.i) + (1 << e.i) = 31),
o AS (SELECT 'ABCDE'[a + 1] || 'ABCDE'[b + 1] || 'ABCDE'[c + 1] || 'ABCDE'[d + 1] || 'ABCDE'[e + 1] AS filter_order, s.i + 1 AS step, [a, b, c, d, e][s.i + 1] AS fi,
  list_sum([(1 << z) FOR z IN [a, b, c, d, e][1:s.i]]) AS seen FROM p, k s),
q AS (SELECT part, filter_order, step, fi, sum(CASE WHEN (mask & (coalesce(seen, 0)::INT | (1 << fi))) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN (mask & (1 << fi)) > 0 AND (mask & coalesce(seen, 0)::INT) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN (mask & (1 << fi)) > 0 AND (mask & coalesce(seen, 0)::INT) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = (1 << fi) THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN (mask & (1 << fi)) > 0 AND (mask & coalesce(seen, 0)::INT) = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN (mask & (1 << fi)) > 0 AND (mask & coalesce(seen, 0)::INT) = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost FROM c, o GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, fi))::BIGINT AS shapley FROM q
"""
