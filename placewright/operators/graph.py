"""Connected components of duplicate pairs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .skew import HOT_ROWS, measured_join, whole


def _chosen(edges: DataFrame, first: bool, turn: int) -> DataFrame:
    """(v, to): each vertex with the foremost among itself and its neighbours: the smallest id at first, then by a hash that changes every turn."""
    def place(c: str) -> Column:
        return F.struct((F.lit(0).cast("long") if first else F.xxhash64(F.lit(turn), c)).alias("h"), F.col(c).alias("v"))
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    near = both.groupBy("v").agg(F.min(place("w")).alias("least"))
    return near.select("v", F.least(place("v"), "least")["v"].alias("to"))


def _followed(chosen: DataFrame, hot_rows: int) -> DataFrame:
    """Every vertex one step further: to what its choice has chosen."""
    target = chosen.select(F.col("v").alias("to"), F.col("to").alias("_next"))
    return measured_join(chosen, target, ["to"], ["v"], "left", hot_rows).select("v", F.coalesce("_next", "to").alias("to"))


def contracted(edges: DataFrame, first: bool, turn: int, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(v, to) of all vertices, and the edges that are left between what they went to. ``edges`` is a stored table."""
    chosen = written(_followed(written(_chosen(edges, first, turn)), hot_rows))
    moved = edges
    for side, other in (("a", "b"), ("b", "a")):
        target = chosen.select(F.col("v").alias(side), F.col("to").alias("_to"))
        moved = written(measured_join(moved, target, [side], [other], "inner", hot_rows).select(F.col("_to").alias(side), other))
    left = moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return chosen, written(left)


def components(edges: DataFrame, a: str = "id_a", b: str = "id_b", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, component) for every id in an edge; the component is its smallest id.

    Each turn every vertex moves two steps to a foremost neighbour and the edges between those that are left make the next,
    smaller graph: what has come together is not read again. Stars and cliques around their smallest id, the usual groups of
    copies, are done in one turn; long chains lose more than half of their vertices in each. The moves are followed
    backwards at the end.
    """
    rows = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    alone = written(rows)
    rest, moves = alone.where("a != b"), []
    while not rest.isEmpty():
        chosen, rest = contracted(rest, not moves, len(moves), hot_rows)
        moves.append(chosen)
    if not moves:
        return alone.select(F.col("a").alias("id"), F.col("a").alias("component"))
    roots = moves[-1]
    for chosen in reversed(moves[:-1]):
        target = roots.select(F.col("v").alias("to"), F.col("to").alias("_root"))
        roots = written(measured_join(chosen, target, ["to"], ["v"], "left", hot_rows).select("v", F.coalesce("_root", "to").alias("to")))
    least = roots.groupBy("to").agg(F.min(F.least("v", "to")).alias("component"))
    found = written(measured_join(roots, written(least), ["to"], ["v"], "inner", hot_rows).select(F.col("v").alias("id"), "component"))
    loops = alone.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component")).join(whole(found), "id", "left_anti")
    return found.unionByName(loops)
