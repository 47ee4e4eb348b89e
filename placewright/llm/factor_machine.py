"""Quality classifier: a factorisation machine over hashed words, structure statistics and text length.

Features of a text: its words hashed to ``BUCKETS`` columns (counts scaled to length one) and statistics of structure
and size, each cut into ``BINS`` equal steps of a fixed scale. The score is the logistic of
``w0 + w.x + sum_f ((x.v_f)^2 - (x*x).(v_f*v_f)) / 2``, so all pairwise interactions cost linear time.

The model is fitted on at most ``SAMPLE`` labelled rows, taken in the order of a hash of the id, outside the held-out
fold; their feature rows (``BUCKETS + BINS * statistics`` numbers each) are all that the driver ever sees. Labels, language,
source and id are no inputs of a score. Every text is then scored whole in one pass without shuffle.

Null and empty texts have no words and are scored on their statistics alone. Rows without label are scored only; labels
that are null or name no document are ignored. Without any usable label, or with one class alone, the score is the share
of label 1 seen (0.5 if none). Each input row gives one output row, repeated rows included.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded, table
from .words import WHITE_LOWER, Words, blocks, shingles

BUCKETS, BINS, FACTORS, SAMPLE, EPOCHS = 1024, 12, 8, 6000, 60
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
STATISTICS = ("words", "bytes", "word_length", "capitals", "symbols", "bangs", "bars", "digits", "stops", "distinct", "twins", "echo",
              "dup_lines", "line_words", "top_word", "long_words")
WIDTH = BUCKETS + BINS * len(STATISTICS)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def features(texts: list[bytes]) -> np.ndarray:
    """A row of WIDTH numbers for each text of a block."""
    n = len(texts)
    w = Words(texts, WHITE_LOWER)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.diff(w.bounds) - 1
    words = w.counts
    count = lambda flags: _per_text(flags, w.bounds)
    class_of = np.zeros(256, np.uint8)
    for mark, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>", b"!", b"|", b"0123456789", b".,;:?"), 1):
        class_of[list(chars)] = mark
    kind = class_of[raw]
    per_word = lambda flags: np.bincount(w.doc[flags], minlength=n)
    key = (w.doc.astype(np.uint64) << np.uint64(40)) ^ (w.hash >> np.uint64(24))
    values, times = np.unique(key, return_counts=True)
    owner = (values >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, times)
    twins = np.zeros(len(w.hash), bool)
    if len(w.hash) > 1:
        twins[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    grams, of = shingles(w.hash, w.first, w.doc, 3)
    kinds = np.bincount((np.unique((of.astype(np.uint64) << np.uint64(40)) ^ (grams >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=n)
    runs = np.bincount(of, minlength=n)
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    dup = np.array([len(x) - len(set(x)) for x in lines])
    length = np.bincount(w.doc, weights=w.ends - w.starts, minlength=n)
    log = lambda x, most: np.clip(np.log1p(x) / np.log1p(most), 0, 1)
    stats = [log(words, 20000), log(size, 100000), log(length / np.maximum(words, 1), 40), _share(count(kind == 1), size),
             _share(count(kind == 2), size), _share(count(kind == 3), size), _share(count(kind == 4), size), _share(count(kind == 5), size),
             _share(count(kind == 6), size), _share(distinct, words), _share(per_word(twins), words), _share(runs - kinds, runs),
             _share(dup, n_lines), log(words / n_lines, 500), _share(top, words), _share(per_word(w.ends - w.starts > 14), words)]
    out = np.zeros((n, WIDTH), np.float32)
    at = w.doc * BUCKETS + (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
    bag = np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, :BUCKETS] = bag / np.maximum(np.sqrt((bag.astype(np.float64) ** 2).sum(1, keepdims=True)), 1)
    for s, value in enumerate(stats):
        out[np.arange(n), BUCKETS + s * BINS + np.minimum((value * BINS).astype(np.int64), BINS - 1)] = 1
    return out


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.factors) ** 2 - (x * x) @ (self.factors ** 2)).sum(1) / 2
        return self.bias + x @ self.weights + pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, factors: int = FACTORS, rate: float = 0.02, ridge: float = 1e-4) -> Machine:
    """Logistic loss, Adam over batches; the same rows in the same order give the same model."""
    share = float(y.mean()) if len(y) else 0.5
    start = np.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3)))
    rng = np.random.default_rng(7)
    m = Machine(start, np.zeros(WIDTH, np.float32), rng.normal(0, 0.01, (WIDTH, factors)).astype(np.float32))
    if not len(y) or share in (0.0, 1.0):
        return Machine(start, m.weights, np.zeros_like(m.factors))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), m.weights, m.factors)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 256):
            rows = order[lo:lo + 256]
            a = x[rows]
            e = ((m.score(a) - y[rows]) / len(rows)).astype(np.float32)
            av = a @ m.factors
            grads = [np.array([e.sum()]), a.T @ e + ridge * m.weights,
                     a.T @ (av * e[:, None]) - ((a * a).T @ e)[:, None] * m.factors + ridge * m.factors]
            step += 1
            for p, (g, (first, second)) in enumerate(zip(grads, moments)):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
                if p == 0:
                    m.bias -= float(move[0])
                elif p == 1:
                    m.weights -= move
                else:
                    m.factors -= move
    return m


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality",
          usable=None, sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most ``sample`` labelled rows for which ``usable`` holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & (usable if usable is not None else F.lit(True)))
    chosen = (known.groupBy(F.col(ident).alias("id")).agg(F.max(label).alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, held in blocks(batch["text"].tolist()):
                part = batch.iloc[at:at + len(held)]
                yield pd.DataFrame({"id": part["id"], "y": part["y"], "x": [r.tobytes() for r in features(held)]})
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # ``sample`` rows at most
    # a repeated document counts once, so that the rows that come back are bounded by the sample
    got = (rows.mapInPandas(turn, f"id {kind}, y int, x binary").groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x"))
           .toPandas().sort_values("id"))
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), WIDTH)
    return fit(x, got["y"].to_numpy(np.float32))


def score_texts(docs: DataFrame, machine: Machine, text: str = "text", score: str = "score") -> DataFrame:
    """The rows with a score (replacing a column so named)."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [sent.value.score(features(held)) for _, held in blocks(batch.tolist(), 1 << 18)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))
    return docs.withColumn(score, F.pandas_udf(rate, "double")(F.col(text)))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with ``score`` and ``predicted``, learned outside the held-out fold."""
    machine = train(docs, labels, usable=folded("doc_id", FOLDS) != HELD_OUT)
    return score_texts(docs, machine).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op5_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classified(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", (folded("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
