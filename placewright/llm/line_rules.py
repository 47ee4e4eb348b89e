"""Quality rules: per-text word rules, then cross-document line frequency within each host.

Lines (divided by \\n) are normalised: A-Z lower-cased, digit runs as one 0, white space collapsed. A line's frequency is
the number of distinct documents of its host that hold it; exact copies of one text count as one document, so that
copying alone, which deduplication treats, makes no line frequent. A line is removed where it stands in at least
``min_docs`` documents and ``min_percent`` of the documents of its host. A document is depleted, and rejected, if less than
``keep_percent`` of its words are left.

Hosts may hold a third of all rows and a line may be everywhere: lines are first reduced to one row per host, line and
text (a key that spreads the hottest host and line), then counted with map-side sums. Only hashes and counts are shuffled,
never texts. Null and empty texts have no words and fail the base rule; a null host is a host of its own; a table without
rows gives none. Each input row gives one output row, repeated rows included; other columns are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, stored, table
from .words import WHITE, Words, blocks, shingles

MIN_WORDS, MAX_REPEAT = 50, 50
MIN_DOCS, MIN_PERCENT, KEEP_PERCENT = 20, 1, 30
SYMBOLS = b"#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
NO_HOST = "\x00"


def _dup_lines(text: bytes) -> int:
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    return sum(lines.values()) - len(lines)


def _repeat_words(w: Words, n: int) -> np.ndarray:
    """Per text, the words that stand in a 3-word window found twice or more in the text."""
    if len(w.hash) < 3:
        return np.zeros(n, np.int64)
    whole = w.doc[:-2] == w.doc[2:]
    start = np.flatnonzero(whole)
    grams, of = shingles(w.hash, w.first, w.doc, 3)
    long = w.counts[of] >= 3  # a text of fewer words has no window
    key = grams[long] ^ (of[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    again = start[times[at] > 1]
    hit = np.zeros(len(w.hash), bool)
    for k in range(3):
        hit[again + k] = True
    return np.bincount(w.doc[hit], minlength=n)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    drop = bytes(set(range(256)) - set(SYMBOLS))
    for batch in batches:
        for at, held in blocks(batch["text"].tolist()):
            w = Words(held, WHITE)
            point = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))  # code points before each byte
            chars = np.bincount(w.doc, weights=point[w.ends] - point[w.starts], minlength=len(held)).astype(np.int64)
            part = batch.iloc[at:at + len(held)]
            yield pd.DataFrame({"id": part["id"], "host": part["host"], "content": part["content"], "n_words": w.counts, "word_chars": chars,
                                "n_symbols": [len(t.translate(None, drop)) for t in held], "n_dup_lines": [_dup_lines(t) for t in held],
                                "n_repeat_words": _repeat_words(w, len(held))})


def normal_line(line: Column) -> Column:
    small = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(small, SPACE, " "), "[0-9]+", "0"))


def _keyed(docs: DataFrame, text: str, host: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(host).cast("string"), F.lit(NO_HOST)).alias("host"), F.xxhash64(F.col(text)).alias("content"), F.col(text).alias("text"))


def _counted(rows: DataFrame, min_docs: int, min_percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(host, line, content, n, words) of each line in one text; (host, content, copies); (host, line) of the frequent lines."""
    each = rows.select("host", "content", F.explode(F.split("text", "\n")).alias("line")).select("host", "content", normal_line(F.col("line")).alias("line"))
    each = each.where("line != ''").select("host", "content", F.xxhash64("line").alias("line"),
                                           (F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1).alias("words"))
    # copies of a text repeat its lines; dividing by their number would need it, so the words are taken per occurrence in one copy
    once = each.groupBy("host", "line", "content").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    seen = rows.groupBy("host", "content").agg(F.count(F.lit(1)).alias("copies"))
    size = seen.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    often = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("in_docs")).where(F.col("in_docs") >= min_docs).join(size, "host")
    return once, seen, often.where(100 * F.col("in_docs") >= min_percent * F.col("docs")).select("host", "line")


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(host, line): hashes of the normalised lines above both limits, as ``strip_lines`` takes them."""
    return _counted(_keyed(docs, text, host), min_docs, min_percent)[2]


def clean_lines(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_percent: int = MIN_PERCENT) -> DataFrame:
    """The rows with frequent lines removed from the text, and ``removed_words``, counted as the words that the text lost."""
    count = lambda t: F.size(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    out = _stripped(docs, frequent_lines(docs, text, host, min_docs, min_percent), text, host)
    return out.select(*_replaced(docs, text), (count(F.col(f"r.{text}")) - count(F.col("t"))).cast("long").alias("removed_words"))


def line_rules(docs: DataFrame, ident: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS,
               min_percent: int = MIN_PERCENT, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """One row per text: id, host, the base measures, ``base_failed``, ``removed_words`` (in frequent lines) and ``kept``."""
    said, back = carried(docs, ident)
    rows = _keyed(docs, text, host, said.alias("id"))
    base = rows.mapInPandas(_measure, "id string, host string, content bigint, n_words bigint, word_chars bigint, n_symbols bigint, "
                                      "n_dup_lines bigint, n_repeat_words bigint")
    once, seen, often = _counted(rows, min_docs, min_percent)
    gone = once.join(often, ["host", "line"]).groupBy("host", "content").agg(F.sum(F.col("n") * F.col("words")).alias("all_removed"))
    gone = gone.join(seen, ["host", "content"]).select("host", "content", F.expr("all_removed div copies").alias("removed_words"))
    out = base.join(gone, ["host", "content"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * left >= keep_percent * F.col("n_words"))).select(
        back("id").alias(ident), F.nullif("host", F.lit(NO_HOST)).alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "removed_words", "kept")


def strip_lines(docs: DataFrame, often: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The texts without the lines of ``often`` (host, line hash), line ends kept; one row per input row, other columns as they were."""
    return _stripped(docs, often, text, host).select(*_replaced(docs, text))


def _replaced(docs: DataFrame, text: str) -> list[Column]:
    return [F.col("t").alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in docs.columns]


def _stripped(docs: DataFrame, often: DataFrame, text: str, host: str) -> DataFrame:
    """(r, t): whole rows as one value, so that no name can clash, and their texts without the frequent lines."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("r")), "strip")  # numbered once, read twice
    each = keyed.select("row", F.coalesce(F.col(f"r.`{host}`").cast("string"), F.lit(NO_HOST)).alias("host"),
                        F.posexplode(F.split(F.col(f"r.`{text}`"), "\n")).alias("at", "said"))
    kept = each.withColumn("line", F.xxhash64(normal_line(F.col("said")))).join(often.select("host", "line"), ["host", "line"], "left_anti")
    made = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("l"))
    made = made.select("row", F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("left_over"))
    return keyed.join(made, "row", "left").select("r", F.when(F.col(f"r.`{text}`").isNotNull(), F.coalesce("left_over", F.lit(""))).alias("t"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                                "base_failed", "removed_words", "kept")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS times FROM p),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE times > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, sum(c - 1) AS n_dup FROM (
  SELECT doc_id, l, count(*) AS c FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
nl AS (SELECT doc_id, host, t, trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS l FROM ln),
f AS (SELECT host, l FROM (SELECT host, l, count(DISTINCT t) AS n FROM nl WHERE l <> '' GROUP BY ALL) JOIN
  (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host) USING (host) WHERE n >= {MIN_DOCS} AND 100 * n >= {MIN_PERCENT} * docs),
x AS (SELECT doc_id, sum(len(string_split(l, ' ')))::BIGINT AS removed FROM nl SEMI JOIN f USING (host, l) GROUP BY doc_id),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND 100 * (n_words - removed_words) >= {KEEP_PERCENT} * n_words AS kept FROM b
"""
