"""Words of many texts at once as arrays of 64-bit hashes, for use inside tasks.

Texts are joined into one byte buffer and cut at separator bytes, so the cost per word is a few array steps. Blocks are
bounded in bytes; one text is never split, so a very long text makes a block of its own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_POWER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_POWER, -1, 1 << 64)
UPPER = bytes(range(65, 91))
SPACES = bytes([32, *range(9, 14)])


def byte_table(separators: bytes, lower: bool) -> bytes:
    """A translation table: separators become a blank, A-Z small letters if asked."""
    table = bytearray(range(256))
    if lower:
        for c in UPPER:
            table[c] = c + 32
    for c in separators:
        table[c] = 32
    return bytes(table)


#: words divided by ASCII white space, with and without A-Z lower-cased
WHITE = byte_table(SPACES, False)
WHITE_LOWER = byte_table(SPACES, True)
#: words of digits, letters a-z (A-Z lower-cased) and all bytes beyond ASCII
ALNUM_LOWER = byte_table(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two multiply-shift rounds)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between calls up to one block."""
    global _powers, _inverses
    if len(_powers) >= n:
        return _powers[:n], _inverses[:n]
    size = max(n, BLOCK + 1)
    p = np.full(size, _POWER, np.uint64)
    q = np.full(size, _INVERSE, np.uint64)
    p[0] = q[0] = 1
    p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
    if size <= 4 * BLOCK:
        _powers, _inverses = p, q
    return p[:n], q[:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans hash alike wherever they stand."""
    p, q = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a block of texts: hash, byte span in ``data`` and number of the text, in order."""

    def __init__(self, texts: list[bytes], table: bytes, drop: bytes = b""):
        texts = [t.translate(table, drop) for t in texts]
        joined = b" ".join(texts) + b" "
        self.bytes = joined
        self.data = np.frombuffer(joined, np.uint8)
        blank = self.data == 32
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = spans_hash(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i]:self.ends[i]]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of each run of n words; a text of fewer words, but not none, gives its whole run.

        The two cases never share a hash, as the length is part of it.
        """
        return shingles(self.hash, self.first, self.doc, n)


def shingles(h: np.ndarray, first: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(first)
    if len(h) >= n:
        acc = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            acc = acc * np.uint64(_POWER) + h[k:len(h) - n + 1 + k]
        whole = doc[:len(acc)] == doc[n - 1:]
        out, of = mix(acc[whole] + np.uint64(n)), doc[:len(acc)][whole]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j, d in enumerate(short):
            a = 0
            for x in h[first[d]:first[d + 1]].tolist():
                a = (a * _POWER + x) & 0xFFFFFFFFFFFFFFFF
            extra[j] = (a + int(counts[d])) & 0xFFFFFFFFFFFFFFFF
        out, of = np.concatenate((out, mix(extra))), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as UTF-8) in blocks of about ``limit`` bytes; null counts as empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield at, held
