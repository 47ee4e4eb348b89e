"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

A text is read as fragments, and no sentence is cut or rated: words by white space, A-Z lower-cased, ASCII punctuation left out, and runs of
single letters joined, so ``i-d-i-o-t`` and ``i d i o t`` are the fragment ``idiot``. The kernel of two fragments sums,
over all three-byte subsequences within ``SPAN`` bytes, the product of their weights ``DECAY ** length``; inserted or
missing characters lower it but do not break it. It is divided by the roots of a norm that depends on length alone.

Training takes at most ``SAMPLE`` labelled texts of each class in the order of a hash of the id, outside the held-out
fold. A toxic text says only that some sentence of it is toxic; the witness fragments are, among those that clean texts
lack, the ones that cover the toxic texts greedily and those that many of them hold, without the clusters of words that a
group of near copies shares. Witnesses, variants of them with a character inserted or left out, and fragments of clean
texts (drawn by hash, then those the first machine rates worst) train the machine on the Nyström map of the landmarks. As the
kernel is linear in subsequences, landmarks and machine collapse to one weight per hashed subsequence, and a fragment is
scored in time linear in its length. A text rates as its worst fragment; a logistic
fit on the sample turns that into the score.

Labels, language, source and id are no inputs of a score. Every text is scored whole, in one pass without shuffle. Null
and empty texts have no fragment and get the score of the lowest rating. Without toxic or clean labels every score is the
share of label 1 (0.5 if there is none). Each input row gives one output row, repeated rows included.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded, stored, table
from .words import WHITE_LOWER, Words, blocks

SPAN, DECAY, LONGEST, DIMS = 6, 0.7, 24, 1 << 16
SAMPLE, CANDIDATES, WITNESSES, CLUSTER, NEGATIVES, HARD, ROUNDS = 2500, 3000, 200, 12, 3000, 1000, 4
LANDMARKS = 256
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
PUNCTUATION = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
LOWEST = -4.0


def fragments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], Words]:
    """(hash, text number, rank in words or -1, joined runs of single letters, words) of a block of texts."""
    w = Words(texts, WHITE_LOWER, PUNCTUATION)
    single = (w.ends - w.starts) == 1
    joined, owner = [], []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], single, [False])).astype(np.int8)))
    for a, b in zip(edge[0::2], edge[1::2]):
        for d in range(int(w.doc[a]), int(w.doc[b - 1]) + 1):
            lo, hi = max(a, int(w.first[d])), min(b, int(w.first[d + 1]))
            if hi - lo >= 3:
                joined.append(b"".join(w.word(i) for i in range(lo, hi)))
                owner.append(d)
    return w.hash, w.doc, np.array(owner, np.int64), joined, w


def cut_long(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of over LONGEST bytes as overlapping pieces; the number of its word for each piece."""
    out, of = [], []
    for i, x in enumerate(words):
        for at in range(0, max(len(x) - LONGEST // 2, 1), LONGEST // 2) if len(x) > LONGEST else (0,):
            out.append(x[at:at + LONGEST])
            of.append(i)
    return out, np.array(of, np.int64)


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) + 2 for x in words), np.int64, len(words))
    wide = max(int(sizes.max(initial=0)), 3)
    return np.frombuffer(b"".join((b"\1" + x + b"\2").ljust(wide, b"\0") for x in words), np.uint8).reshape(len(words), wide).astype(np.uint32), sizes


_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
#: norm of a fragment by its length; its start and end count as characters
_NORM = np.sqrt(np.array([max(sum(max(n + 2 - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in _STEPS), 1e-9) for n in range(LONGEST + 1)]))


def subsequences(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pair of gaps: (hashed subsequence by word and start, weight or 0 beyond the word's end)."""
    chars, sizes = _matrix(words)
    for a, b in _STEPS:
        n = chars.shape[1] - a - b
        if n <= 0:
            continue
        code = (chars[:, :n] * np.uint32(0x9E3779B1) ^ chars[:, a:a + n] * np.uint32(0x85EBCA77) ^ chars[:, a + b:a + b + n] * np.uint32(0xC2B2AE3D))
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield (code >> np.uint32(16)).astype(np.int64), np.where(np.arange(n) + a + b < sizes[:, None], DECAY ** (a + b + 1), 0).astype(np.float32)


def profile(words: list[bytes]) -> np.ndarray:
    """A normed row of DIMS weights per word."""
    out = np.zeros((len(words), DIMS), np.float32)
    row = np.arange(len(words))[:, None]
    for code, weight in subsequences(words):
        np.add.at(out, (np.broadcast_to(row, code.shape), code), weight)
    return out / _NORM[[len(x) for x in words]][:, None]


def _kernel(words: list[bytes], by_code: np.ndarray) -> np.ndarray:
    """The kernel of each word with every landmark, the landmarks' profiles given by subsequence."""
    out = np.zeros((len(words), by_code.shape[1]), np.float32)
    for code, weight in subsequences(words):
        out += np.einsum("ij,ijk->ik", weight, by_code[code])
    return out / _NORM[[len(x) for x in words]][:, None].astype(np.float32)


def rate(words: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin of each fragment; a fragment of fewer than three bytes rates lowest."""
    if not words:
        return np.zeros(0)
    pieces, of = cut_long(words)
    total = np.zeros(len(pieces))
    for lo in range(0, len(pieces), 20000):
        part = pieces[lo:lo + 20000]
        got = np.zeros(len(part))
        for code, weight in subsequences(part):
            got += (weights[code] * weight).sum(1)
        size = np.array([len(x) for x in part])
        total[lo:lo + 20000] = np.where(size < 3, LOWEST, np.maximum(got / _NORM[size] + bias, LOWEST))
    out = np.full(len(words), LOWEST)
    np.maximum.at(out, of, total)
    return out


def variants(word: bytes) -> list[bytes]:
    """The word with a character inserted or left out in its inner part."""
    put = [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (b"x", b"q", b"0")] if len(word) > 3 else []
    return put + ([word[:i] + word[i + 1:] for i in range(1, len(word) - 1)] if len(word) > 4 else [])


@dataclass
class Machine:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit(good: list[bytes], bad: list[bytes], extra: list[bytes], hard: int = 0) -> Machine:
    """Squared-hinge machine on the Nyström map of landmarks taken from both sides, folded back to subsequence weights."""
    marks = list(dict.fromkeys(bad[:LANDMARKS // 2] + good[:LANDMARKS - min(len(bad), LANDMARKS // 2)]))
    base = profile(marks)
    gram = base.astype(np.float64) @ base.T
    values, vectors = np.linalg.eigh(gram)
    by_code = np.ascontiguousarray(base.T)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    words = bad + extra + good
    x = np.concatenate([_kernel(words[lo:lo + 100], by_code) for lo in range(0, len(words), 100)]) @ root
    x = np.concatenate((x, np.zeros((1, x.shape[1]))))  # a fragment like no landmark is clean
    y = np.concatenate((np.ones(len(bad) + len(extra)), -np.ones(len(good) + 1)))
    # variants and easy clean fragments weigh less than witnesses and hard ones
    cost = np.concatenate([np.full(n, share / max(n, 1)) for n, share in ((len(bad), 1.0), (len(extra), 0.3), (hard, 3.0), (len(good) - hard, 0.5), (1, 1.0))])
    a, p, ridge = np.column_stack((x, np.ones(len(x)))), np.zeros(x.shape[1] + 1), np.append(np.full(x.shape[1], 1e-4), 1e-9)

    def loss(q: np.ndarray) -> float:
        return float((cost * np.maximum(1 - y * (a @ q), 0) ** 2).sum() + (ridge * q * q).sum())
    for _ in range(100):  # Newton steps on the rows inside the margin, halved until they help
        inside = y * (a @ p) < 1
        part, c = a[inside], cost[inside, None]
        step = np.linalg.solve(part.T @ (part * c) + np.diag(ridge), part.T @ (c[:, 0] * y[inside])) - p
        size, now = 1.0, loss(p)
        while size > 1e-4 and loss(p + size * step) > now:
            size /= 2
        p = p + size * step
        if np.abs(size * step).max() < 1e-7 or size <= 1e-4:
            break
    w, b = p[:-1], float(p[-1])
    return Machine((base.T @ (root @ w)).astype(np.float32), b)


def _witnesses(found: pd.DataFrame, toxic: int) -> list[bytes]:
    """Fragments to blame: a greedy cover of the toxic texts, and every fragment that many of them hold.

    Words of a group of near copies come in large clusters that stand in the same texts; these are left out first.
    """
    names = [bytes(f) for f in found["fragment"]]
    if not names:
        return []
    ids = {d: i for i, d in enumerate(sorted({d for x in found["ids"] for d in x}))}
    held = np.zeros((len(names), len(ids)), np.float32)
    for r, x in enumerate(found["ids"]):
        held[r, [ids[d] for d in x]] = 1
    both, size = held @ held.T, held.sum(1)
    alike = (both >= 0.6 * (size[:, None] + size[None, :] - both)).sum(1) - 1
    apart = np.flatnonzero(alike <= CLUSTER)
    out, left = [], held.any(0)
    while len(out) < WITNESSES and len(apart):
        gain = held[apart] @ left
        best = int(apart[np.argmax(gain)])
        if best in out or gain.max() < max(3, 0.005 * toxic):
            break
        out.append(best)
        left &= held[best] == 0
    often = [int(i) for i in apart[np.argsort(-size[apart], kind="stable")] if size[i] >= max(3, 0.02 * toxic)]
    return [names[i] for i in dict.fromkeys([*out, *often])][:WITNESSES]


def _sample(docs: DataFrame, labels: DataFrame, ident: str, text: str, label: str, usable, sample: int) -> DataFrame:
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & (usable if usable is not None else F.lit(True)))
    known = known.groupBy(F.col(ident).alias("id")).agg(F.max(label).alias("y"))
    order = [F.xxhash64("id"), "id"]
    chosen = known.where("y = 1").orderBy(*order).limit(sample).unionByName(known.where("y = 0").orderBy(*order).limit(sample))
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # 2 * sample rows at most
    return stored(rows.groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", usable=None,
          sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled texts of each class for which ``usable`` holds."""
    rows = _sample(docs, labels, ident, text, label, usable, sample)
    n = {y: c for y, c in rows.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        share = n.get(1, 0) / max(sum(n.values()), 1) if n else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Machine(np.zeros(DIMS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, held in blocks(batch["text"].tolist()):
                _, _, owner, joined, w = fragments(held)
                for d in range(len(held)):
                    own = {w.word(i) for i in range(int(w.first[d]), int(w.first[d + 1]))} | {j for j, o in zip(joined, owner) if o == d}
                    own = [x for x in cut_long(sorted(own))[0] if len(x) >= 3]
                    yield pd.DataFrame({"id": batch["id"].iloc[at + d], "y": batch["y"].iloc[at + d], "fragment": own})
    kind = docs.schema[ident].dataType.simpleString()
    each = stored(rows.mapInPandas(cut, f"id {kind}, y int, fragment binary"), "fragments")
    count = each.groupBy("fragment").agg(F.countDistinct(F.when(F.col("y") == 1, F.col("id"))).alias("bad"),
                                         F.countDistinct(F.when(F.col("y") == 0, F.col("id"))).alias("good"))
    expected = F.col("good") * F.lit(n[1] / n[0])
    odd = count.where((F.col("bad") >= 2) & (F.col("bad") >= 20 * expected)).orderBy(F.desc(F.col("bad") - expected), "fragment").limit(CANDIDATES)
    toxic = each.where("y = 1").join(F.broadcast(odd.select("fragment")), "fragment")  # CANDIDATES rows at most
    bad = _witnesses(toxic.groupBy("fragment").agg(F.collect_set("id").alias("ids")).orderBy("fragment").toPandas(), n[1])  # bounded by the sample
    clean = count.where("good > 0")
    good = [bytes(r[0]) for r in clean.orderBy(F.xxhash64("fragment"), "fragment").select("fragment").limit(NEGATIVES).collect()]
    if not bad:
        return Machine(np.zeros(DIMS, np.float32), 0.0, 0.0, float(np.log(n[1] / n[0])))
    blamed = set(bad)  # a witness that a few clean texts hold stays one
    good = [g for g in good if g not in blamed]
    extra = list(dict.fromkeys(v for b in bad for v in variants(b) if len(v) <= LONGEST))
    said = docs.sparkSession.createDataFrame([(bytearray(v),) for v in extra] or [(bytearray(b""),)], "fragment binary")
    innocent = {bytes(r[0]) for r in clean.join(F.broadcast(said), "fragment").select("fragment").collect()}  # variants that clean texts hold
    extra = [v for v in extra if v not in innocent and v not in blamed]
    machine, hard = fit(good, bad, extra), []
    for _ in range(ROUNDS):
        worst = clean.withColumn("margin", _margin(spark_sent(docs, machine))("fragment")).orderBy(F.desc("margin"), "fragment").limit(HARD)
        hard = list(dict.fromkeys(hard + [f for f in (bytes(r[0]) for r in worst.select("fragment").collect()) if f not in blamed]))
        machine = fit([*hard, *(g for g in good if g not in set(hard))], bad, extra, len(hard))
    rated = rate_texts(rows, machine).select("y", "margin").toPandas()  # 2 * sample rows at most
    machine.slope, machine.offset = _logistic(rated["margin"].to_numpy(), rated["y"].to_numpy())
    return machine


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, both classes weighing alike, with a ridge that keeps separable data finite."""
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    a, p = np.column_stack((x, np.ones(len(x)))), np.zeros(2)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a @ p, -30, 30)))
        g = a.T @ (weight * (s - y)) + 1e-3 * p * (1, 0)
        h = a.T @ (a * (weight * s * (1 - s))[:, None]) + np.diag((1e-3, 1e-9))
        step = np.linalg.solve(h, g)
        p = p - step
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


def spark_sent(docs: DataFrame, machine: Machine):
    return docs.sparkSession.sparkContext.broadcast((machine.weights, machine.bias))


def _margin(sent):
    @F.pandas_udf("double")
    def margin(batch: pd.Series) -> pd.Series:
        return pd.Series(rate([bytes(x) for x in batch], *sent.value))
    return margin


def rate_texts(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows with ``margin``, the rating of the worst fragment (replacing a column so named)."""
    sent = spark_sent(docs, machine)

    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = 1 << 20  # a table of rated words of fixed size: a word is rated again if another took its slot
        keys, margins = np.zeros(slots, np.uint64), np.zeros(slots, np.float32)
        weights, bias = sent.value
        for batch in batches:
            found = []
            for _, held in blocks(batch.tolist()):
                h, doc, owner, joined, w = fragments(held)
                slot = (h & np.uint64(slots - 1)).astype(np.int64)
                new = keys[slot] != h
                out = np.full(len(held), LOWEST)
                if new.any():
                    _, at = np.unique(h[new], return_index=True)
                    at = np.flatnonzero(new)[at]
                    fresh = rate([w.word(i) for i in at], weights, bias)
                    np.maximum.at(out, doc[new], fresh[np.searchsorted(h[at], h[new])])
                    np.maximum.at(out, doc[~new], margins[slot[~new]])
                    keys[slot[at]], margins[slot[at]] = h[at], fresh
                else:
                    np.maximum.at(out, doc, margins[slot])
                if joined:
                    np.maximum.at(out, owner, rate(joined, weights, bias))
                found.append(out)
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))
    return docs.withColumn("margin", F.pandas_udf(worst, "double")(F.col(text)))


def score_texts(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows with ``score`` and ``margin``."""
    z = F.greatest(F.least(F.col("margin") * machine.slope + machine.offset, F.lit(30.0)), F.lit(-30.0))
    return rate_texts(docs, machine, text).withColumn("score", 1 / (1 + F.exp(-z)))


def op9_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"), usable=folded("doc_id", FOLDS) != HELD_OUT)
    return score_texts(docs, machine).select("doc_id", (folded("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                                             F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
