"""Full-text search over a postings table, and free-query relevance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import query_relevance
from ..functions.text import col

K1, B = 1.2, 0.75


def terms_of(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda t: t != "")


def build_postings(df: DataFrame, ident: str, columns: list[str], lists: list[str] | None = None) -> DataFrame:
    """(term, id, tf, doc_len): counts per term and row; nulls count as empty text."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns] + [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ") for c in (lists or [])]
    # texts are dealt out by id before they are cut: fewer bytes than their words, which then need no second shuffle; by number, as words take more memory
    deal = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = df.select(F.col(ident).alias("id"), F.concat_ws(" ", *parts).alias("_x")).repartition(deal, "id").select("id", terms_of("_x").alias("_t"))
    # an outer one, as the planner cuts texts once more below the shuffle to leave out those without words
    one = words.select("id", F.size("_t").alias("doc_len"), F.explode_outer("_t").alias("term")).where("term IS NOT NULL")
    return one.groupBy("term", "id", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def collection_size(df: DataFrame, ident: str, columns: list[str], lists: list[str] | None = None) -> DataFrame:
    """One row: number of rows and total terms; rows without terms count too."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns] + [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ") for c in (lists or [])]
    return df.select(F.size(terms_of(F.concat_ws(" ", *parts))).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms"))


def update_postings(postings: DataFrame, changed: DataFrame, removed_ids: DataFrame, ident: str, columns: list[str], lists: list[str] | None = None) -> DataFrame:
    """Postings after inserts, updates and deletes: only the touched ids are rebuilt."""
    touched = changed.select(F.col(ident).alias("id")).unionByName(removed_ids.select(F.col(ident).alias("id"))).distinct()
    return postings.join(touched, "id", "left_anti").select(*postings.columns).unionByName(build_postings(changed, ident, columns, lists).select(*postings.columns))


def match_all(postings: DataFrame, sizes: DataFrame, query: str) -> DataFrame:
    """(id, score) of rows that hold every query term, BM25 with k1 1.2 and b .75; higher is better.

    The query terms are constants, so only their postings are read; rows are grouped by id, never by term.
    """
    words = sorted({w for w in _query_terms(query)})
    if not words:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    hit = postings.where(F.col("term").isin(words))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_docs, n_terms = sizes.first()
    avg = (n_terms or 0) / n_docs if n_docs else 0.0
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(avg or 1.0)))
    # one row per query word, so the side to broadcast is bounded by the query
    scored = hit.join(F.broadcast(df), "term").select("id", (idf * tf).alias("s"))
    return scored.groupBy("id").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(words)).drop("_n")


def _query_terms(query: str) -> list[str]:
    import regex
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if t]


def rank_by_query(df: DataFrame, query: str, ident: str, name="name", description="description", tags="tags", flags="flags", top: int = 20) -> DataFrame:
    """Rows with any points for the query, best first; ties by id."""
    scored = df.withColumn("relevance", query_relevance(query, name, description, tags, flags)).where("relevance > 0")
    return scored.orderBy(F.desc("relevance"), ident).limit(top)


def query_total(df: DataFrame, query: str, name="name", description="description", tags="tags", flags="flags") -> DataFrame:
    return df.where(query_relevance(query, name, description, tags, flags) > 0).agg(F.count(F.lit(1)).alias("total"))
