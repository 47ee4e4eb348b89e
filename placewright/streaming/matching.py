"""Duplicates of new rows among everything seen before, through a stored match index."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import resolve as R
from ..operators import similarity as S
from ..session import cut_lineage
from ..sources.store import Store

#: grid cells of an index of points, as parts of the tolerance: fine ones first, as most neighbours stand near
LEVELS = (1 / 256, 1 / 16, 1)
KINDS = ("identity", "address", "name", "point")


def _entries(base: DataFrame, seq: str, ratio: float, block: list[str], tolerance: float) -> DataFrame:
    """(kind, key, seq, name, its signature, block value, x, y): what later rows look for. A name stands under each of its segments."""
    share = 1 - ratio
    none = F.lit(None).cast("string")
    signs = [F.lit(None).cast("long").alias(c) for c in ("s0", "s1")]
    spare = [none.alias("name"), *signs, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")]
    exact = [base.where(F.coalesce(F.col(c), F.lit("")) != "").select(F.lit(kind).alias("kind"), F.xxhash64(c).alias("key"), F.col(seq).alias("seq"), F.col(c).alias("value"), *spare)
             for kind, c in (("identity", "match_key"), ("address", "_address"))]
    names = _named(base, seq, share, block)
    carry = [F.col(c).alias(to) for c, to in (("_id", "seq"), ("_block", "value"), ("_t", "name"), ("_s0", "s0"), ("_s1", "s1"))]
    keyed = S.own_keys(names, "_block, ", "_far", *carry)
    whole = names.select(F.expr("xxhash64(_block, -1, 0, _t)").alias("_key"), *carry)
    keyed = keyed.unionByName(whole).select(F.lit("name").alias("kind"), F.col("_key").alias("key"), "seq", "value", "name", "s0", "s1", *spare[3:])
    points = base.where("geo_lat is not null and geo_lng is not null")
    cells = [points.select(F.lit("point").alias("kind"), _cell(level, F.floor(F.col("geo_lat") / (tolerance * part)), F.floor(F.col("geo_lng") / (tolerance * part))).alias("key"),
                           F.col(seq).alias("seq"), F.lit(str(level)).alias("value"), none.alias("name"), *signs, F.col("geo_lat").alias("x"), F.col("geo_lng").alias("y"))
             for level, part in enumerate(LEVELS)]
    out = exact[0].unionByName(exact[1]).unionByName(keyed)
    for c in cells:
        out = out.unionByName(c)
    return earliest(out)


def earliest(entries: DataFrame) -> DataFrame:
    """Of equal entries the one of the smallest row: no later one is ever matched, so a value many rows share stays one entry."""
    same = [c for c in entries.columns if c not in ("seq", "_run")]
    return entries.groupBy(*same).agg(F.min("seq").alias("seq")).select(*[c for c in entries.columns if c != "_run"])


def _cell(level: int, x, y):
    return F.xxhash64(F.lit(level), x, y)


def _named(base: DataFrame, seq: str, share: float, block: list[str]) -> DataFrame:
    value = F.to_json(F.struct(*block)) if block else F.lit("")
    rows = base.where(F.coalesce(F.col("match_name"), F.lit("")) != "").select(F.col(seq).alias("_id"), value.alias("_block"), F.col("match_name").alias("_t"), *[F.col(b).alias(f"_b_{b}") for b in block])
    for b in block:
        rows = rows.where(F.col(f"_b_{b}").isNotNull())
    return S.with_signature(rows.select("_id", "_block", "_t", F.length("_t").alias("_n"), F.expr(S.farthest("length(_t)", share)).alias("_far")))


def _asked(base: DataFrame, seq: str, ratio: float, block: list[str], tolerance: float) -> DataFrame:
    """(kind, key, asker, and the values to compare): where the rows of a batch look in the index."""
    share = 1 - ratio
    none = F.lit(None).cast("string")
    signs = [F.lit(None).cast("long").alias(c) for c in ("a_s0", "a_s1")]
    spare = [none.alias("a_name"), *signs, F.lit(None).cast("double").alias("a_x"), F.lit(None).cast("double").alias("a_y")]
    out = None
    for kind, c in (("identity", "match_key"), ("address", "_address")):
        part = base.where(F.coalesce(F.col(c), F.lit("")) != "").select(F.lit(kind).alias("kind"), F.xxhash64(c).alias("key"), F.col(seq).alias("asker"), F.col(c).alias("a_value"), *spare)
        out = part if out is None else out.unionByName(part)
    names = _named(base, seq, share, block)
    carry = [F.col("_id").alias("asker"), F.col("_block").alias("a_value"), F.col("_t").alias("a_name"), F.col("_s0").alias("a_s0"), F.col("_s1").alias("a_s1")]
    keyed = S.asked_both_ways(names, "_block, ", share, *carry).distinct()
    whole = names.select(F.expr("xxhash64(_block, -1, 0, _t)").alias("_key"), *carry)
    out = out.unionByName(keyed.unionByName(whole).select(F.lit("name").alias("kind"), F.col("_key").alias("key"), "asker", "a_value", "a_name", "a_s0", "a_s1", *spare[3:]))
    return out


def _around(points: DataFrame, level: int, tolerance: float) -> DataFrame:
    size = tolerance * LEVELS[level]
    step = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    near = points.withColumn("dx", step).withColumn("dy", step)
    return near.select(_cell(level, F.floor(F.col("a_x") / size) + F.col("dx"), F.floor(F.col("a_y") / size) + F.col("dy")).alias("key"), "asker", "a_x", "a_y")


def match_stored(store: Store, batch: DataFrame, seq: str = "seq", ratio: float = rules.FUZZY_NAME_RATIO, tolerance: float = rules.GEO_TOLERANCE,
                 block: list[str] | None = None, state: dict | None = None) -> DataFrame:
    """(seq, match, strategy rank, score): for each batch row and strategy its best match in the stored index.

    Only the buckets that hold a key of the batch are read. ``batch`` has the match columns.
    """
    block = ["city"] if block is None else block
    state = state or store.state()
    asked = cut_lineage(_asked(batch, seq, ratio, block, tolerance))
    held = store.read("index", asked.select("key"), state)
    met = asked.join(held, ["kind", "key"])
    exact = met.where((F.col("kind") != "name") & (F.col("value") == F.col("a_value"))).groupBy("asker", "kind").agg(F.min("seq").alias("match"))
    exact = exact.select(F.col("asker").alias(seq), "match", F.when(F.col("kind") == "identity", 0).otherwise(2).alias("_s"))
    # compared inside the join, and grouped before the score is filtered: a word that many names share makes all of them meet
    longest = "greatest(length(a_name), length(name))"
    most = f"cast(floor({longest} * {1 - ratio!r}D + {S.EPS!r}D) as int)"
    near = met.where((F.col("kind") == "name") & (F.col("value") == F.col("a_value"))).where(
        f"abs(length(a_name) - length(name)) <= {most} and bit_count(a_s0 ^ s0) + bit_count(a_s1 ^ s1) <= 2 * {most} and levenshtein(a_name, name, {most}) >= 0")
    close = near.groupBy("asker", "seq").agg(F.min(F.levenshtein("a_name", "name")).alias("_d"), F.max(F.expr(longest)).alias("_n"))
    close = close.withColumn("score", 1 - F.col("_d") / F.col("_n")).where(F.col("score") >= ratio)
    # of equal names the earliest stands for the others, as in one run over all rows
    named = close.groupBy("asker").agg(F.max_by(F.col("seq"), F.struct(F.col("score"), -F.col("seq"))).alias("match"), F.max("score").alias("score"))
    out = exact.withColumn("score", F.lit(1.0)).unionByName(named.select(F.col("asker").alias(seq), "match", F.lit(1).alias("_s"), "score"))
    points = batch.where("geo_lat is not null and geo_lng is not null").select(F.col(seq).alias("asker"), F.col("geo_lat").alias("a_x"), F.col("geo_lng").alias("a_y"))
    for level in range(len(LEVELS)):
        around = cut_lineage(_around(points, level, tolerance))
        held = store.read("index", around.select("key"), state).where((F.col("kind") == "point") & (F.col("value") == str(level)))
        dx, dy = F.col("a_x") - F.col("x"), F.col("a_y") - F.col("y")
        near = around.join(held, "key").withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= tolerance * LEVELS[level])
        best = cut_lineage(near.groupBy("asker").agg(F.min(F.struct("d", "seq")).alias("m")))
        out = out.unionByName(best.select(F.col("asker").alias(seq), F.col("m.seq").alias("match"), F.lit(3).alias("_s"), (-F.col("m.d")).alias("score")))
        # who found a neighbour nearby asks no wider cell
        points = points.join(best.select("asker"), "asker", "left_anti")
    return out


def match_batch(store: Store, batch: DataFrame, seq: str = "seq", ratio: float = rules.FUZZY_NAME_RATIO, tolerance: float = rules.GEO_TOLERANCE,
                block: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((seq, match, strategy), index entries of the batch): each row against earlier batches and earlier rows of its own.

    Rows of earlier batches count as earlier whatever their number; of equally good matches the earlier one is taken.
    """
    blocks = ["city"] if block is None else block
    base = R.with_match_columns(batch).withColumn("_address", F.when(F.col("match_address") != "", F.col("address_hash")))
    base = cut_lineage(base.select(seq, *dict.fromkeys([*blocks, "match_name", "match_key", "match_address", "address_hash", "_address", "geo_lat", "geo_lng"])))
    parts = [p.withColumn("_s", F.lit(i)) for i, p in enumerate(R.match_parts(base, seq, ratio, tolerance, blocks))]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    entries = _entries(base, seq, ratio, blocks, tolerance)
    state = store.state()
    if "index" in state["tables"]:
        found = found.unionByName(match_stored(store, base, seq, ratio, tolerance, blocks, state).select(seq, "match", "score", "_s"))
    # within a strategy the better score, then the earlier row; identity and address links are to the earliest row of all
    best = found.groupBy(seq, "_s").agg(F.max_by("match", F.struct("score", -F.col("match"))).alias("match"))
    names = F.array(*[F.lit(s) for s in R.STRATEGIES])
    return (best.groupBy(seq).agg(F.min(F.struct("_s", "match")).alias("m"))
            .select(seq, F.col("m.match").alias("match"), F.element_at(names, F.col("m._s") + 1).alias("strategy")), entries)


def against_stored(root: str, seq: str = "seq", buckets: int = 64, **matching) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: table ``rows`` gets the batch, ``matches`` what it matched, ``index`` what later batches look for.

    A batch reads the buckets of its own keys and writes its own rows; a replayed batch changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, root, buckets)
        change = store.change(batch_id)
        if change is None:
            return
        rows = cut_lineage(batch)
        matches, entries = match_batch(store, rows, seq, **matching)
        change.put("rows", rows, [seq])
        change.put("matches", matches, [seq])
        change.put("index", entries, ["key"])
        change.compact("index", earliest)
        change.commit()
    return write


def kept_rows(spark: SparkSession, root: str, seq: str = "seq") -> DataFrame:
    """The rows that matched no earlier one."""
    store = Store(spark, root)
    return store.read("rows").drop("_run").join(store.read("matches").select(seq), seq, "left_anti")


def matched(spark: SparkSession, root: str) -> DataFrame:
    """(seq, match, strategy) of all rows so far."""
    return Store(spark, root).read("matches").drop("_run")
