"""Exact top-k search by inner product: a Voronoi join with bounds from cell summaries.

Pivots are a bounded sample of vectors. Queries and data belong to the cell of their nearest pivot. Of each query cell the
summary is its radius and, over all data, the k + 1 highest scores that every query of the cell is sure of (``<g, x> - radius
* |x|``, one more than k as a query is no candidate of its own); of each data cell it is the radius. A pair of cells is
left out when no score inside can reach what the query cell is sure of (``<g, p> + |g| * R + radius * (|p| + R)``), and of the
other cells a row is sent only where its own bound ``<g, x> + radius * |x|`` reaches it. Query cells are packed into
groups of at most ``GROUP`` queries (a larger cell is dealt over several), data into slices by a hash of the row, so that
neither a hot cell nor copies of one vector gather in a task. A task holds the queries of its group and streams the rows of
its slice, best scores kept; the slices of a query are ranked at last.

Scores are exact: products are summed in 64-bit floats where the sum surely stays below 2^53, else in Python's integers.
Bounds are widened by a part in a billion, so rounding loses no row. Where vectors lie in no clusters the bounds hold back
little and each row goes to every group once: work is then queries times rows, in blocks.

Vectors that are null or hold null or non-finite components take no part. A shorter vector counts as ending in zeros. Each row is
its own query; rows that repeat an id are each other's candidates. A null id is never a query; as a candidate it stands behind
equal scores. Empty tables give empty results. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: most pivots; the driver holds their vectors and a square table of their bounds
PIVOTS = 256
#: queries of a group, and most rows of a slice
GROUP, SLICE = 16384, 1 << 20
#: queries and rows whose scores are held at once
BLOCK = 1024
SLACK = 1e-9


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """List entries as rows, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(at)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered floats; beyond 2^53 as Python's integers."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2 ** 53:
        return q @ x.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q).dot(whole(x).T), -(1 << 63), (1 << 63) - 1)


def highest(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row in their order of standing, the earliest of equal ones."""
    if s.shape[1] <= k:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    least = np.sort(s, axis=1)[:, [-k]] if s.dtype == object else np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
    over, same = s > least, s == least
    return np.nonzero(over | (same & (np.cumsum(same, axis=1) <= k - over.sum(1, keepdims=True))))[1].reshape(len(s), k)


class Cells:
    """Pivots and the bounds of query cells; small, sent to every task."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.norms = np.linalg.norm(pivots, axis=1)
        self.radius = self.sure = self.wanted = None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance from the pivot, rounded up."""
        d = self.norms ** 2 - 2 * (x @ self.pivots.T)
        cell = d.argmin(1)
        return cell, np.linalg.norm(x - self.pivots[cell], axis=1) * (1 + SLACK)

    def least(self, x: np.ndarray) -> np.ndarray:
        """Scores that every query of a cell is sure to have with a vector, cell by cell."""
        dots, norms = self.pivots @ x.T, np.linalg.norm(x, axis=1)
        return dots - np.multiply.outer(self.radius, norms) - SLACK * (1 + np.multiply.outer(self.norms + self.radius, norms))

    def may(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Query cell by vector: may the vector be among the best of one of the cell's queries?"""
        dots, norms = self.pivots @ x.T, np.linalg.norm(x, axis=1)
        most = dots + np.multiply.outer(self.radius, norms) + SLACK * (1 + np.multiply.outer(self.norms + self.radius, norms))
        return self.wanted[:, cell] & (most >= self.sure[:, None])

    def bound(self, radius: np.ndarray, sure: np.ndarray, held: np.ndarray) -> None:
        """What the query cells are sure of against the best inside each data cell (``held``: its radius, nan if empty)."""
        self.sure = sure
        dots = self.pivots @ self.pivots.T
        reach = np.multiply.outer(self.norms, held) + np.multiply.outer(radius, self.norms + held)
        best = dots + reach + SLACK * (1 + np.multiply.outer(self.norms, self.norms) + reach)
        self.wanted = ~np.isnan(sure)[:, None] & (best >= sure[:, None])


def clean(df: DataFrame, ident: str, vector: str, whole: Column | None = None) -> DataFrame:
    """(id, v) of the rows that take part; vectors as 64-bit floats."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector).isNotNull() & ok)
    return rows.select(F.col(ident).alias("id"), (F.col(vector).cast("array<double>") if whole is None else whole).alias("v"))


def top_products(rows: DataFrame, queries: Column, k: int = 5, pivots: int = PIVOTS, group: int = GROUP, slice_rows: int = SLICE) -> DataFrame:
    """(query_id, rank, id, score) over rows (id, v) of whole-numbered vectors; ``queries`` marks the rows asked for.

    ``pivots``, ``group`` and ``slice_rows`` deal out the work and never change a result.
    """
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    # numbered once: the number stands for the row from here on
    base = stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.coalesce(queries, F.lit(False)).alias("q")), "vectors")
    seen = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q"), F.max(F.size("v")).alias("width"), F.max(F.aggregate(
        F.transform("v", lambda x: F.abs(x)), F.lit(0.0), lambda a, x: F.greatest(a, x))).alias("far")).first()
    shape = f"query_id {kind}, rank int, id {kind}, score bigint"
    if not seen["q"]:
        return spark.createDataFrame([], shape)
    width = seen["width"]
    taken = base.select("v").distinct().orderBy(F.xxhash64("v")).limit(max(1, min(pivots, isqrt(seen["q"])))).toArrow()
    cells = Cells(matrix(taken["v"], width))
    count = len(cells.pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = cells.nearest(matrix(b["v"], width))
            yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["v"], b["q"], pa.array(cell.astype(np.int32)), pa.array(far)],
                                             ["row", "id", "v", "q", "cell", "far"])
    placed = stored(base.mapInArrow(place, f"row bigint, id {kind}, v array<double>, q boolean, cell int, far double"), "cells")
    held, radius, asked = np.full(count, np.nan), np.zeros(count), np.zeros(count, np.int64)
    for cell, far, far_q, n in placed.groupBy("cell").agg(F.max("far"), F.max(F.when(F.col("q"), F.col("far"))), F.count_if("q")).collect():
        held[cell], radius[cell], asked[cell] = far, far_q or 0, n
    cells.radius = radius

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((count, 0), 0.0)
        for b in batches:
            best = np.concatenate((best, cells.least(matrix(b["v"], width))), axis=1)
            best = np.take_along_axis(best, highest(best, k + 1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(count, dtype=np.int32), best.shape[1])), pa.array(best.ravel())], ["cell", "least"])
    sure = np.where(asked > 0, -np.inf, np.nan)
    ranked = placed.select("v").mapInArrow(lowest, "cell int, least double").withColumn(
        "r", F.row_number().over(Window.partitionBy("cell").orderBy(F.col("least").desc()))).where(F.col("r") == k + 1)
    for cell, least, _ in ranked.collect():
        if asked[cell]:
            sure[cell] = least
    cells.bound(radius, sure, held)

    # query cells packed into groups, a cell of many queries into several
    first, parts, used, room = np.zeros(count, np.int64), np.maximum(1, -(-asked // group)), 0, 0
    groups: list[list[int]] = []
    for cell in np.flatnonzero(asked):
        if parts[cell] > 1 or asked[cell] > room:
            first[cell], room = used, 0 if parts[cell] > 1 else group - asked[cell]
            used += parts[cell]
            groups += [[cell] for _ in range(parts[cell])]
        else:
            first[cell], room = used - 1, room - asked[cell]
            groups[-1].append(cell)
    slices = max(1, ceil(seen["n"] / max(BLOCK, min(slice_rows, seen["n"] // 64))))
    at = F.array(*[F.lit(int(x)) for x in first])
    of = F.array(*[F.lit(int(x)) for x in parts])
    lot = F.pmod(F.xxhash64("row"), F.get(of, F.col("cell")))
    asking = (placed.where("q").withColumn("g", (F.get(at, F.col("cell")) + lot).cast("int"))
              .select("g", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), F.lit(0).alias("side"), "id", "row", "v", "cell"))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = cells.may(matrix(b["v"], width), b["cell"].to_numpy())
            need = np.array([may[list(g)].any(0) for g in groups])
            g, i = np.nonzero(need)
            for lo in range(0, len(g), 4096):
                part = b.select(["id", "row", "v", "cell"]).take(pa.array(i[lo:lo + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(g[lo:lo + 4096].astype(np.int32)), *part.columns], ["g", "id", "row", "v", "cell"])
    sent = placed.select("id", "row", "v", "cell").mapInArrow(replicate, f"g int, id {kind}, row bigint, v array<double>, cell int").select(
        "g", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("s"), F.lit(1).alias("side"), "id", "row", "v", "cell")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            g, s, side = (b[c].to_numpy() for c in ("g", "s", "side"))
            turn = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (side[1:] != side[:-1]), [True])))
            for lo, hi in zip(turn[:-1], turn[1:]):
                if held is None or held.key != (g[lo], s[lo]):
                    if held is not None:
                        yield from held.result()
                    held = _Task((g[lo], s[lo]), cells, width, k)
                (held.data if side[lo] else held.query)(b.slice(lo, hi - lo))
        if held is not None:
            yield from held.result()
    both = asking.unionByName(sent).repartition("g", "s").sortWithinPartitions("g", "s", "side", F.col("id").asc_nulls_last(), "row")
    found = both.mapInArrow(solve, f"q bigint, query_id {kind}, id {kind}, row bigint, score bigint")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


class _Task:
    """Queries of one group and the best rows of one slice so far. Rows come in the order that breaks ties."""

    def __init__(self, key: tuple, cells: Cells, width: int, k: int) -> None:
        self.key, self.cells, self.width, self.k = key, cells, width, k
        self.parts: list[pa.RecordBatch] = []
        self.open = None

    def query(self, b: pa.RecordBatch) -> None:
        self.parts.append(b)

    def _ready(self) -> None:
        whole = pa.Table.from_batches(self.parts)
        self.ids, self.rows, cell = whole["id"], whole["row"].to_numpy(), whole["cell"].to_numpy()
        self.v = matrix(whole["v"], self.width)
        self.open = [(c, np.flatnonzero(cell == c)) for c in np.unique(cell)]
        n = len(self.v)
        self.score, self.row = np.zeros((n, 0)), np.zeros((n, 0), np.int64)
        self.names = self.ids.combine_chunks().slice(0, 0)  # ids of rows that stand among the best, by place
        self.place = np.zeros((n, 0), np.int64)

    def data(self, b: pa.RecordBatch) -> None:
        if not self.parts:
            return
        if self.open is None:
            self._ready()
        for lo in range(0, b.num_rows, BLOCK):
            self._block(b.slice(lo, BLOCK))

    def _block(self, b: pa.RecordBatch) -> None:
        x, rows, cell = matrix(b["v"], self.width), b["row"].to_numpy(), b["cell"].to_numpy()
        may = self.cells.may(x, cell)
        n, k = len(self.v), self.k
        at = np.arange(b.num_rows) + len(self.names)
        wide = np.full((n, k), -np.inf) if self.score.dtype != object else np.full((n, k), -np.inf, object)
        row, place = np.full((n, k), -1), np.full((n, k), -1)
        wide[:, :self.score.shape[1]], row[:, :self.row.shape[1]], place[:, :self.row.shape[1]] = self.score, self.row, self.place
        for c, of in self.open:
            cols = np.flatnonzero(may[c])
            for lo in range(0, len(of) if len(cols) else 0, BLOCK):
                q = of[lo:lo + BLOCK]
                s = scores(self.v[q], x[cols])
                if s.dtype == object and wide.dtype != object:
                    wide = wide.astype(object)
                s = np.where(self.rows[q][:, None] == rows[cols], -np.inf, s)
                s = np.concatenate((wide[q], s), axis=1)
                best = highest(s, k)
                pick = lambda a, b: np.take_along_axis(np.concatenate((a[q], np.broadcast_to(b, (len(q), len(b)))), axis=1), best, axis=1)  # noqa: E731,B023
                wide[q], row[q], place[q] = np.take_along_axis(s, best, axis=1), pick(row, rows[cols]), pick(place, at[cols])
        self.score, self.row = wide, row
        # only ids that are still among the best are kept
        ids = pa.concat_arrays([self.names, b["id"]])
        used, back = np.unique(place, return_inverse=True)
        back = back.reshape(place.shape)
        kept = used[used >= 0]
        self.names, self.place = ids.take(pa.array(kept)), back - (len(used) - len(kept))

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.open is None:
            return
        q, j = np.nonzero(self.place >= 0)
        real = np.array([s != -np.inf for s in self.score[q, j]], bool) if len(q) else np.zeros(0, bool)
        q, j = q[real], j[real]
        yield pa.RecordBatch.from_arrays([
            pa.array(self.rows[q]), self.ids.combine_chunks().take(pa.array(q)), self.names.take(pa.array(self.place[q, j])),
            pa.array(self.row[q, j]), pa.array([int(s) for s in self.score[q, j]], pa.int64())], ["q", "query_id", "id", "row", "score"])


def op12_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    floors = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    rows = clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", floors)
    return top_products(rows, F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


SQL = r"""
WITH v AS (SELECT rowid AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM
  (SELECT row_number() OVER () AS rowid, * FROM embeddings) WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""
