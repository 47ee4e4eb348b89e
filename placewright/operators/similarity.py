"""Similarity joins whose keys grow more selective with the rows.

Texts: a text of length l is cut into one segment more than the edits it allows; a close text has to hold one of them unchanged, near
its place. So each text offers its own segments and asks for the pieces of itself that could be a segment of a text of its length
or longer, and an equi-join on (length, segment number, piece) finds every pair. Segments are of equal size, but where a crowd of texts
offers the same one (a word that many names share), the texts of that block and length are cut where a sample of them says that the
fewest pairs meet: the shared word then lies in one segment together with letters that differ. Sets: the rarest few elements of a set, by exact
counts, and a pair has to share one of them at places that leave room for the wanted overlap. An element that only one
row has can meet nothing and is never joined.

Texts travel with their keys and are compared inside the join, behind a signature of their letters, so that only pairs that are close leave
it. Of sets only ids and numbers travel; they are fetched for the pairs whose places and sizes fit, and compared exactly.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gestalt_ratio, jaccard
from ..session import written
from .skew import HOT_ROWS, salted_join, whole

EPS = 1e-9
#: where so many texts offer a segment, the texts of that block and length are cut anew, after a look at so many of them
CROWD, LOOKED_AT = 128, 512
#: places between which a cut is looked for, at most
PLACES = 64
#: a table of (block, length) with no more rows is broadcast
FEW = 50_000


def _edits(length: str, share: float) -> str:
    """SQL: edits allowed in a text that is the longer one of its pair."""
    return f"cast(floor({length} * {share!r}D + {EPS!r}D) as int)"


def _segment(length: str, edits: str, i: str) -> tuple[str, str]:
    """SQL: first place (from 1) and size of the i-th of edits + 1 segments; the last ones are the longer by one."""
    base, short = f"cast(({length}) div ({edits} + 1) as int)", f"({edits} + 1 - ({length}) % ({edits} + 1))"
    return f"(1 + ({i} - 1) * {base} + greatest(0, {i} - 1 - {short}))", f"({base} + if({i} > {short}, 1, 0))"


def farthest(length: str, share: float) -> str:
    """SQL: by how much the longest partner of a text is longer, which no number of edits between them exceeds."""
    return f"cast(floor({length} * {share / (1 - share)!r}D + {EPS!r}D) as int)"


def _cut(rows: DataFrame, length: str, edits: str) -> DataFrame:
    """A row for each segment _i with its place _at and _size: as the array _cut says (places, and the end), or of equal size."""
    at, size = _segment(length, edits, "_i")
    if "_cut" in rows.columns:
        at, size = f"coalesce(_cut[_i - 1], {at})", f"coalesce(_cut[_i] - _cut[_i - 1], {size})"
    cut = rows.where(f"{edits} > 0").select("*", F.expr(f"explode(sequence(1, {edits} + 1))").alias("_i"))
    return cut.withColumns({"_at": F.expr(at), "_size": F.expr(size)})


def own_keys(rows: DataFrame, block: str, edits: str, *carry: Column) -> DataFrame:
    """Keys of the segments of each text (_t of length _n), one more than its column of edits says."""
    return _cut(rows, "_n", edits).select(F.expr(f"xxhash64({block}_n, _i, substring(_t, _at, _size))").alias("_key"), *carry)


def asked_keys(rows: DataFrame, block: str, share: float, lengths: DataFrame, *carry: Column) -> DataFrame:
    """Keys of the pieces of each text that could be a segment of a text of the same length or of a longer one.

    ``lengths`` has the (_g, _l) that occur, with their _cut.
    """
    longer = rows.select("*", F.expr("explode(sequence(_n, _n + _far))").alias("_l")).withColumn("_m", F.expr(_edits("_l", share))).where("_l - _n <= _m")
    return _pieces(longer.join(lengths, ["_g", "_l"]), block, *carry)


def asked_both_ways(rows: DataFrame, block: str, share: float, *carry: Column) -> DataFrame:
    """The same for texts of any length, shorter ones too, cut for the most edits that any partner of theirs allows."""
    least = f"cast(ceil(_n * {1 - share!r}D - {EPS!r}D) as int)"
    lengths = rows.select("*", F.expr(f"explode(sequence({least}, _n + _far))").alias("_l")).withColumn("_m", F.expr(farthest("_l", share)))
    return _pieces(lengths.where("abs(_l - _n) <= _m"), block, *carry)


def _pieces(lengths: DataFrame, block: str, *carry: Column) -> DataFrame:
    """Keys of the pieces of texts that could be a segment of a text of length _l cut for _m edits.

    A piece lies at most i - 1 places from the i-th segment seen from the left, and as many as there are segments behind
    it seen from the right: errors on that side are fewer, or another segment matches.
    """
    cut = _cut(lengths, "_l", "_m")
    near = cut.withColumns({"_low": F.expr("greatest(1, _at - (_i - 1), _at + _n - _l - (_m + 1 - _i))"),
                            "_high": F.expr("least(_n - _size + 1, _at + (_i - 1), _at + _n - _l + (_m + 1 - _i))")}).where("_low <= _high")
    return near.select("*", F.expr("explode(sequence(_low, _high))").alias("_p")).select(F.expr(f"xxhash64({block}_l, _i, substring(_t, _p, _size))").alias("_key"), *carry)


def _crowded(rows: DataFrame, own: DataFrame, crowds: DataFrame) -> DataFrame:
    """Rows with the numbers _held of those of their segments that a crowd offers."""
    held = own.join(whole(crowds), "_key").groupBy(F.col("_id_a").alias("_id")).agg(F.array_sort(F.collect_list("_i")).alias("_held"))
    return rows.join(whole(held), "_id", "left").withColumn("_held", F.coalesce("_held", F.array().cast("array<int>")))


def best_cut(texts: list[str], edits: int) -> list[int]:
    """Places (from 1) of the segments of texts of one length, and the end: so cut that the fewest pairs share a segment, each counted at as many
    places as it may be shifted to."""
    n, parts = len(texts[0]), edits + 1
    marks = sorted({round(x) for x in np.linspace(0, n, min(n, max(PLACES, 2 * parts)) + 1)})
    letters = np.array([[ord(c) for c in t] for t in texts], dtype=np.uint64)
    factor, running, power = np.uint64(0x9E3779B97F4A7C15), np.zeros((len(texts), n + 1), np.uint64), np.ones(n + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(n, factor))  # hashes wrap around
    for j in range(n):
        running[:, j + 1] = running[:, j] * factor + letters[:, j] + np.uint64(1)
    cost = np.full((len(marks), len(marks)), np.inf)
    for a, i in enumerate(marks):
        for b in range(a + 1, len(marks)):
            piece = np.sort(running[:, marks[b]] - running[:, i] * power[marks[b] - i])
            runs = np.diff(np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True]))))
            cost[a, b] = (runs * (runs - 1)).sum() / max(1, len(texts) * (len(texts) - 1)) + 1e-9 * (marks[b] - i) ** 2
    best, came = cost[0], []
    for p in range(2, parts + 1):
        total = best[:, None] + cost * (2 * min(p - 1, parts - p) + 1)
        came.append(total.argmin(axis=0))
        best = total.min(axis=0)
    at, out = len(marks) - 1, [n + 1]
    for step in reversed(came):
        at = step[at]
        out.append(marks[at] + 1)
    return [1, *reversed(out)]


def _lengths(rows: DataFrame, marked: DataFrame | None) -> DataFrame:
    """(_g, _l, _cut) of the blocks and lengths that occur; _cut is null where no segment is crowded. Where to cut is a matter of cost alone, so a sample will do."""
    found = rows.select("_g", F.col("_n").alias("_l")).distinct()
    if marked is None:
        out = found.withColumn("_cut", F.lit(None).cast("array<int>"))
    else:
        groups = marked.where("size(_held) > 0").select("_g", "_n").distinct()
        order = F.row_number().over(Window.partitionBy("_g", "_n").orderBy(F.xxhash64("_id")))
        looked = rows.join(whole(groups), ["_g", "_n"], "left_semi").select("_g", "_n", "_k", "_t", order.alias("_r")).where(F.col("_r") <= LOOKED_AT)

        def cut(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"_g": group["_g"][:1], "_l": group["_n"][:1], "_cut": [best_cut(list(group["_t"]), int(group["_k"].iloc[0]))]})
        out = found.join(whole(looked.groupBy("_g", "_n").applyInPandas(cut, "_g long, _l int, _cut array<int>")), ["_g", "_l"], "left")
    out = written(out)
    return F.broadcast(out) if out.count() <= FEW else whole(out)


def with_signature(df: DataFrame, text: str = "_t") -> DataFrame:
    """Adds 128 bits (_s0, _s1) of the numbers of letters: a letter more or less turns one bit.

    Letters fall into 64 classes of two bits, which count 0, 1, 11, 10 and again 0.
    """
    def word(w: int) -> str:
        count = "(shiftright(s, 2 * c) & 3)"
        return f"aggregate(transform(filter(_c, c -> c div 32 = {w}), c -> cast(c % 32 as int)), 0L, (s, c) -> s ^ shiftleft({count} ^ (({count} * 2 + if({count} < 2, 1, 0)) & 3), 2 * c))"
    classed = df.withColumn("_c", F.expr(f"transform(split({text}, ''), c -> pmod(xxhash64(c), 64))"))
    return classed.withColumns({f"_s{w}": F.expr(word(w)) for w in range(2)}).drop("_c")


def close_texts(nodes: DataFrame, share: float, block: list[str], hot_rows: int = HOT_ROWS, crowd: int = CROWD, replaced: bool = True) -> DataFrame:
    """Distinct pairs (id_a, id_b, edits, longer length) of nodes (_id, _t, block columns) that lie within ``share`` of the longer length in edits.

    Without ``replaced`` letters are only inserted and deleted, within half of ``share`` of both lengths: the pairs whose distance
    with replacements is within that many edits, which holds all of them.
    """
    # dealt out by number: a row becomes many keys, so its bytes say little about its work
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select("_id", "_t", (F.xxhash64(*block) if block else F.lit(0).cast("long")).alias("_g")).repartition(parts, "_id")
    rows = rows.withColumn("_n", F.length("_t")).withColumn("_k", F.expr(_edits("_n", share)))
    rows = written(with_signature(rows.withColumn("_far", F.expr(farthest("_n", share))).where("_k + _far > 0")))
    own = own_keys(rows, "_g, ", "_k", F.col("_id").alias("_id_a"), F.col("_i"))
    counts = written(own.groupBy("_key").agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") >= min(crowd, hot_rows)))
    hot, crowds = counts.where(F.col("_f") >= hot_rows).select("_key"), counts.where(F.col("_f") >= crowd)
    lengths = _lengths(rows, None if crowds.isEmpty() else _crowded(rows.select("_id", "_g", "_n"), own, crowds))
    cut = rows.join(lengths.withColumnRenamed("_l", "_n"), ["_g", "_n"])
    sides = [[F.col(c).alias(f"{c}_{s}") for c in ("_id", "_t", "_n", "_s0", "_s1")] for s in "ab"]
    own, asks = own_keys(cut, "_g, ", "_k", *sides[0], F.col("_k")), asked_keys(rows, "_g, ", share, lengths, *sides[1])
    met = own.join(whole(asks), "_key") if hot.isEmpty() else salted_join(own, asks, ["_key"], ["_id_a"], "inner", hot_rows)
    most, turns = "_k", "2 * _k"
    if not replaced:
        most = turns = f"cast(floor((_n_a + _n_b) * {share / 2!r}D + {EPS!r}D) as int)"
    near = met.where("(_n_b < _n_a or _id_b < _id_a) and _n_a - _n_b <= _k and _n_b <= _n_a "
                     f"and bit_count(_s0_a ^ _s0_b) + bit_count(_s1_a ^ _s1_b) <= {turns} and levenshtein(_t_a, _t_b, {most}) >= 0")
    pairs = near.selectExpr("least(_id_a, _id_b) as id_a", "greatest(_id_a, _id_b) as id_b", "levenshtein(_t_a, _t_b) as _d", "_n_a as _n")
    # aggregated, as a filter on plain columns would pass into the join, before its own condition, and measure every pair that meets
    return pairs.groupBy("id_a", "id_b").agg(F.min("_d").alias("_d"), F.max("_n").alias("_n"))


def text_candidates(nodes: DataFrame, share: float, block: list[str], hot_rows: int = HOT_ROWS, crowd: int = CROWD,
                    replaced: bool = True) -> DataFrame:
    """The distinct pairs (id_a, id_b) of ``close_texts``."""
    return close_texts(nodes, share, block, hot_rows, crowd, replaced).select("id_a", "id_b")


def _nodes(rows: DataFrame, value: Column, block: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with a hash of block and value, one row per block and value, the values that several rows share with their smallest id).

    Rows are read several times, so they are stored once, as tables: these are packed by columns, where a checkpoint keeps whole rows.
    """
    for b in block:
        rows = rows.where(F.col(b).isNotNull())
    rows = written(rows.withColumn("_key", F.unhex(F.sha2(F.to_json(F.struct(*block, value.alias("_v"))).cast("binary"), 256))))
    firsts = written(rows.groupBy("_key").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies")))
    nodes = rows.join(whole(firsts.select(F.col("_key"), F.col("_first").alias("_id"))), ["_key", "_id"], "left_semi").drop("_key")
    return rows, nodes, firsts.where("_copies > 1")


def _fetched(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Pairs with the values of both sides."""
    one = rows.select(F.col("_id").alias("id_a"), F.col(value).alias("_v_a"))
    two = rows.select(F.col("_id").alias("id_b"), F.col(value).alias("_v_b"))
    return pairs.join(whole(one), "id_a").join(whole(two), "id_b")


def similar_texts(df: DataFrame, ident: str, text: str, ratio: float, block: list[str] | None = None,
                  metric: str = "levenshtein", copies: bool = True, hot_rows: int = HOT_ROWS, crowd: int = CROWD) -> DataFrame:
    """Pairs (id_a, id_b, score) with id_a < id_b whose ratio reaches the threshold, complete.

    Equal texts are one node, named by their smallest id; with ``copies`` each other copy is linked to it (score 1).
    ``metric`` is levenshtein (1 - distance / longer length; any ratio) or gestalt (2 * matching / total length; above one half).
    """
    if not (0 if metric == "levenshtein" else 0.5) < ratio < 1:
        raise ValueError("a ratio lies between 0 (gestalt: one half) and 1")
    block = block or []
    rows, nodes, copied = _nodes(df.where((F.coalesce(F.col(text), F.lit("")) != "")).select(F.col(ident).alias("_id"), *block, F.col(text).alias("_t")), F.col("_t"), block)
    # what does not match is inserted or deleted, so two texts lie within twice that share of the longer one
    share = (1 - ratio) * (1 if metric == "levenshtein" else 2)
    close = close_texts(nodes, share, block, hot_rows, crowd, metric == "levenshtein")
    if metric == "levenshtein":
        close = close.withColumn("score", 1 - F.col("_d") / F.col("_n"))
    else:
        # what matches is a common subsequence, so all else can be deleted and inserted: most pairs fail this without Python
        close = _fetched(close.select("id_a", "id_b"), rows, "_t").withColumn("score", gestalt_ratio("_v_a", "_v_b"))
    found = close.where(F.col("score") >= ratio).select("id_a", "id_b", "score")
    return found.unionByName(copy_links(rows, copied, hot_rows)) if copies else found


def copy_links(rows: DataFrame, copied: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each further row of a value linked to the smallest id that has it."""
    linked = salted_join(rows.select("_id", "_key"), copied, ["_key"], ["_id"], "inner", hot_rows, hot=copied.where(F.col("_copies") >= hot_rows).select("_key"))
    return linked.where(F.col("_id") != F.col("_first")).select(F.col("_first").alias("id_a"), F.col("_id").alias("id_b"), F.lit(1.0).alias("score"))


def set_candidates(nodes: DataFrame, above: float, block: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct pairs (id_a, id_b) of nodes (_id, _w, block columns) whose Jaccard index may exceed ``above``.

    Elements are 64-bit hashes (of block and element), ordered by how many nodes hold them. Elements of one node alone stand
    first in that order and use up places of the prefix without being joined.
    """
    prefix = "".join(f"{b}, " for b in block)
    single = written(nodes.select("_id", F.size("_w").alias("_n"), F.explode(F.expr(f"transform(_w, e -> xxhash64({prefix}e))")).alias("_e")))
    counts = single.groupBy("_e").agg(F.count(F.lit(1)).alias("_f")).where("_f > 1")
    counts = written(counts)
    hot = counts.where(F.col("_f") >= hot_rows).select("_e")
    held = salted_join(single, counts, ["_e"], ["_id"], "inner", hot_rows, hot=hot)
    ranked = held.groupBy("_id", "_n").agg(F.sort_array(F.collect_list(F.struct("_f", "_e"))).alias("_h"))
    # the places before the first shared element belong to elements of one node
    ranked = ranked.withColumn("_lone", F.col("_n") - F.size("_h")).withColumn("_len", (F.col("_n") - F.ceil(F.col("_n") * F.lit(above)) + 1).cast("int"))
    keyed = written(ranked.where("_len > _lone").select("_id", "_n", "_lone", F.posexplode(F.slice("_h", F.lit(1), F.col("_len") - F.col("_lone"))).alias("_p", "_x"))
                        .select("_id", "_n", (F.col("_p") + F.col("_lone")).alias("_p"), F.col("_x._e").alias("_e")))
    left, right = (keyed.select("_e", F.col("_id").alias(f"_id_{s}"), F.col("_n").alias(f"_n_{s}"), F.col("_p").alias(f"_p_{s}")) for s in "ab")
    n, m = F.col("_n_a"), F.col("_n_b")
    room = F.least(n - F.col("_p_a"), m - F.col("_p_b"))
    fits = (F.col("_id_a") < F.col("_id_b")) & (F.least(n, m) >= F.greatest(n, m) * F.lit(above) - EPS) & (room >= (n + m) * F.lit(above / (1 + above)) - EPS)
    return salted_join(left, right, ["_e"], ["_id_a"], "inner", hot_rows, hot=hot).where(fits).select(F.col("_id_a").alias("id_a"), F.col("_id_b").alias("id_b")).distinct()


def similar_sets(df: DataFrame, ident: str, words: str, above: float, block: list[str] | None = None,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs (id_a, id_b, score) whose word sets have a Jaccard index above the threshold, complete.

    Equal sets are one node; copies are linked to the smallest id.
    """
    block = block or []
    rows, nodes, copied = _nodes(df.select(F.col(ident).alias("_id"), *block, F.sort_array(F.array_distinct(words)).alias("_w")).where(F.size("_w") > 0), F.col("_w"), block)
    both = _fetched(set_candidates(nodes, above, block, hot_rows), rows, "_w")
    found = both.withColumn("score", jaccard("_v_a", "_v_b")).where(F.col("score") > above).select("id_a", "id_b", "score")
    return found.unionByName(copy_links(rows, copied, hot_rows))


def contains_lookup(df: DataFrame, ident: str, text: str, dim: DataFrame, key: str, order: str, values: list[str],
                    gram: int = 3) -> DataFrame:
    """First dimension row (smallest ``order``) whose key occurs inside the text, for dimensions of any size.

    Joined on the first ``gram`` letters of the key; keys shorter than that join on their own length.
    """
    keyed = dim.where(F.length(key) > 0).select(F.col(key).alias("_key"), F.col(order).alias("_ord"), *values,
                                                F.least(F.length(key), F.lit(gram)).alias("_q"))
    keyed = keyed.withColumn("_g", F.substr("_key", F.lit(1), F.col("_q")))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(ident, low.alias("_low"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda q: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length("_low"), F.lit(1))), lambda i: i + q - 1 <= F.length("_low")),
        lambda i: F.substr(F.col("_low"), i, q))))
    pieces = rows.select(ident, "_low", F.explode(F.array_distinct(grams)).alias("_g"))
    hit = pieces.join(keyed, "_g").where(F.col("_low").contains(F.col("_key")))
    best = hit.groupBy(ident).agg(F.min_by(F.struct(*values), F.col("_ord")).alias("_best"))
    return df.join(best.select(ident, *[F.col(f"_best.{v}").alias(v) for v in values]), ident, "left")
