"""From documents to token ids: quality, line dedup, near-duplicates, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``. A stage's rows are written as Parquet and read again before the next; a stage
reads its docs several times and numbers their rows, so they have to be such a table.

Stages decide on rows, never on ids: null and repeated ids are rows like others, and of equal rows the first one's lines
stay, so the others go with line dedup. Null and empty texts have nothing to remove and are left to the quality classifier.
Other columns pass through, whatever their names. Empty tables give empty results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import decontaminate, factor_machine, hyper_minhash, line_dedup, sentence_pieces
from placewright.llm.common import folded, stored, table


def _whole(docs: DataFrame) -> Column:
    """All columns of a row as one value, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below its threshold go."""
    machine = factor_machine.train(docs, table(spark, sf_dir, "labels"), usable=folded("doc_id", factor_machine.FOLDS) != factor_machine.HELD_OUT)
    scored = factor_machine.score_texts(docs.select(_whole(docs), "text"), machine)
    return scored.where(F.col("score") >= factor_machine.THRESHOLD).select("r.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, but for two edits, go; so do documents of which no word is left."""
    keyed = docs.select(_whole(docs), F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), "text")
    kept = line_dedup.dedup_lines(keyed, "key")
    has = lambda c: F.coalesce(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return kept.where(~has("r.text") | has("text")).select(
        *[new.get(f.name, F.col(f"r.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8) stays: that of the smallest id, a null id last."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), _whole(docs))
    found = hyper_minhash.near_duplicates(rows.select("row", "r.text"), "row").select("row", "component_id")
    named = found.join(rows.select("row", "r.doc_id"), "row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    return rows.join(best.select("best.row"), "row", "left_semi").select("r.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = docs.select(F.monotonically_increasing_id().alias("place"), _whole(docs))
    found = decontaminate.contamination(rows.select("place", "r.text"), table(spark, sf_dir, "benchmark"), "place")
    return rows.join(found.where(F.size("spans") > 0).select("place"), "place", "left_anti").select("r.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, n_bytes, round_trip, parity)."""
    return sentence_pieces.encode_texts(docs.select("doc_id", "text")).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "n_bytes", "round_trip", "parity")


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup_stage), ("near duplicates", near_duplicates),
          ("decontamination", decontamination), ("encoding", encoding)]

#: a fitted classifier and an encoding cannot be stated in SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each earlier one written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
