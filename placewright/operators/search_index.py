"""A stored search index: postings in blocks, in buckets of their terms, with what a block can score at most.

Ids are dealt into slots by a hash. A block is what one term has in one slot: ids, counts and lengths as arrays, and their number,
highest count and least length as plain columns. A query reads the buckets of its words. From the plain columns
follows what a slot can score; slots that lack a word are left out, the most promising ones are scored first, and of
the others those that cannot reach the last of the best rows so far are never unpacked.

An update writes the blocks of the changed ids and the ids themselves; older postings of these ids are passed over when
they are read, until a rebuild of the blocks drops them.
"""
from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from ..sources.store import Change, Store, latest
from .search import B, K1, _query_terms, build_postings

SLOT_ROWS = 1024
#: slots scored before the others are held against their worst row
FIRST_SLOTS = 64


def _blocks(postings: DataFrame, slots: int) -> DataFrame:
    """(term, slot, n, most, least, ids, tfs, lens) of postings (term, id, tf, doc_len)."""
    slot = F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot")
    held = F.array_sort(F.collect_list(F.struct("id", "tf", "doc_len")))
    # dealt out as they are: arrays of parts of a block would be more bytes than the rows
    grouped = postings.withColumn("slot", slot).repartition("term", "slot").groupBy("term", "slot").agg(held.alias("p"), F.max("tf").alias("most"), F.min("doc_len").alias("least"))
    return grouped.select("term", "slot", F.size("p").alias("n"), "most", "least", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.doc_len").alias("lens"))


def _unpacked(blocks: DataFrame) -> DataFrame:
    """(term, slot, id, tf, doc_len, _run) of blocks."""
    zipped = F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lens").alias("doc_len"))).alias("p")
    return blocks.select("term", "slot", "_run", zipped).select("term", "slot", "p.id", "p.tf", "p.doc_len", "_run")


def update_index(store: Store, run: int, changed: DataFrame, ident: str, columns: list[str], lists: list[str] | None = None, removed: DataFrame | None = None) -> None:
    """Rows put into the index (``changed``: new ones and new versions) and taken out (``removed``: their ids), as one change."""
    change = store.change(run)
    if change is not None:
        index_rows(change, changed, ident, columns, lists, removed)
        change.commit()


def index_rows(change: Change, changed: DataFrame, ident: str, columns: list[str], lists: list[str] | None = None, removed: DataFrame | None = None) -> None:
    """The same within a change that other tables share."""
    store, state = change.store, change.state
    fresh = "docs" not in state["tables"]
    postings = written(build_postings(changed, ident, columns, lists))
    lens = changed.select(F.col(ident).alias("id")).join(postings.groupBy("id").agg(F.first("doc_len").alias("n")), "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(True).alias("live"))
    if removed is not None:
        lens = lens.unionByName(removed.select(F.col(ident).alias("id"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("live")).join(lens, "id", "left_anti"))
    lens = cut_lineage(lens)
    docs, terms = lens.agg(F.count_if("live"), F.sum("n")).first()
    if fresh:
        change.set("slots", max(1, -(-docs // SLOT_ROWS)))
        change.set("size", [docs, terms or 0])
    else:
        # only the buckets of the touched ids are read
        before = latest(["id"])(store.read("docs", lens.select("id"), state)).where("live").join(lens.select("id"), "id", "left_semi")
        old_docs, old_terms = before.agg(F.count(F.lit(1)), F.sum("n")).first()
        size = state["values"]["size"]
        change.set("size", [size[0] - old_docs + docs, size[1] - (old_terms or 0) + (terms or 0)])
        change.put("touched", lens.select("id"))
    change.put("postings", _blocks(postings, change.state["values"]["slots"]), ["term"])
    change.put("docs", lens, ["id"])
    change.compact("docs", latest(["id"]))


def rebuild_blocks(store: Store, run: int) -> None:
    """Rewrites all blocks without postings that no longer hold; what was touched is forgotten."""
    change = store.change(run)
    if change is None:
        return
    live = _blocks(written(_live(store, store.read("postings", state=change.state), change.state).drop("slot", "_run")), change.state["values"]["slots"])
    change.state["tables"].pop("postings")
    change.state["tables"].pop("touched", None)
    change.put("postings", live, ["term"])
    change.commit()


def _live(store: Store, blocks: DataFrame, state: dict) -> DataFrame:
    """Unpacked postings without those of ids that a later run has touched."""
    rows = _unpacked(blocks)
    if "touched" not in state["tables"]:
        return rows
    last = store.read("touched", state=state).groupBy("id").agg(F.max("_run").alias("_last"))
    return rows.join(last, "id", "left").where(F.col("_last").isNull() | (F.col("_run") >= F.col("_last"))).drop("_last")


def _part(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average or 1.0)))


def _empty(store: Store) -> DataFrame:
    kind = next(f["type"] for f in store.state()["tables"]["docs"]["schema"]["fields"] if f["name"] == "id")
    return store.spark.createDataFrame([], f"id {kind}, score double")


def best_matches(store: Store, query: str, top: int, slack: float = 1e-6, first_slots: int = FIRST_SLOTS) -> DataFrame:
    """(id, score) of rows that hold every query word: all whose BM25 score reaches that of the ``top``-th best, less ``slack``."""
    words = sorted(set(_query_terms(query)))
    if not words:
        return _empty(store)
    state = store.state()
    n_docs, n_terms = state["values"]["size"]
    average = n_terms / n_docs if n_docs else 0.0
    asked = store.spark.createDataFrame([(w,) for w in words], "term string")
    blocks = store.read("postings", asked, state).where(F.col("term").isin(words))
    if "touched" in state["tables"]:
        # blocks of touched ids are made anew from what still holds, of the words alone
        blocks = cut_lineage(_blocks(_live(store, blocks, state).drop("slot", "_run"), state["values"]["slots"]).withColumn("_run", F.lit(0).cast("long")))
    df = {r.term: r.n for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per query word
    if len(df) < len(words):
        return _empty(store)
    weight = F.create_map(*[x for w in words for x in (F.lit(w), F.lit(log(1 + (n_docs - df[w] + 0.5) / (df[w] + 0.5))))])
    idf = F.element_at(weight, F.col("term"))
    bounds = blocks.groupBy("term", "slot").agg(F.max("most").alias("most"), F.min("least").alias("least")).groupBy("slot").agg(
        F.sum(idf * _part(F.col("most"), F.col("least"), average)).alias("bound"), F.count(F.lit(1)).alias("words")).where(F.col("words") == len(words))

    def scored(slots: DataFrame) -> DataFrame:
        rows = _unpacked(blocks.join(slots.select("slot"), "slot"))
        return rows.groupBy("id").agg(F.sum(idf * _part(F.col("tf"), F.col("doc_len"), average)).alias("score"), F.count(F.lit(1)).alias("_n")).where(
            F.col("_n") == len(words)).drop("_n")
    bounds = cut_lineage(bounds)
    head = bounds.orderBy(F.desc("bound"), "slot").limit(first_slots)
    some = cut_lineage(scored(head))
    worst = some.orderBy(F.desc("score")).limit(top).agg(F.min("score"), F.count(F.lit(1))).first()
    least = worst[0] - slack if worst[1] == top else -1.0
    rest = bounds.join(head.select("slot"), "slot", "left_anti").where(F.col("bound") >= least)
    return some.unionByName(scored(rest)).where(F.col("score") >= least)
