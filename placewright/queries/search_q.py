"""Full-text search and query relevance."""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import ranking as W
from ..operators import search as T
from ..operators import search_index as X
from ..session import work_dir
from ..sources.readers import table
from ..sources.store import Store
from . import sqltext as S
from .inputs import places, with_places
from .registry import query
from .. import rules

_TERMS = "list_filter(regexp_split_to_array(lower({e}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_POST = f"w AS (SELECT doc_id AS id, {_TERMS.format(e='text')} AS t FROM documents), post AS (SELECT term, id, n AS doc_len, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM w) GROUP BY 1, 2, 3)"


@query("postings", "T1", f"WITH {_POST} SELECT term, count(*) AS df, sum(tf)::bigint AS cf FROM post GROUP BY 1")
def _(spark, sf):
    p = T.build_postings(table(spark, sf, "documents"), "doc_id", ["text"])
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("postings_updated", "T2", f"WITH w AS (SELECT doc_id AS id, CASE WHEN source = 'src1' THEN ['changed', 'text'] ELSE {_TERMS.format(e='text')} END AS t FROM documents WHERE source <> 'src2'), post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM w) GROUP BY 1, 2) SELECT id, count(*) AS terms, sum(tf)::bigint AS total FROM post GROUP BY 1")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    base = T.build_postings(docs, "doc_id", ["text"])
    changed = docs.where("source = 'src1'").select("doc_id", F.lit("changed text").alias("text"))
    out = T.update_postings(base, changed, docs.where("source = 'src2'"), "doc_id", ["text"])
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("total"))


_BM = "ln(1 + ((SELECT count(*) FROM w) - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * doc_len / (SELECT avg(len(t)) FROM w)))"


def _document_index(spark, sf) -> Store:
    """The stored index of the documents: made once for the files as they stand, then only read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(path)
    seen = "|".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in files))
    store = Store(spark, f"{work_dir(spark)}/search-{hashlib.sha256(seen.encode()).hexdigest()[:24]}")
    if not store.has("postings"):
        X.update_index(store, 0, table(spark, sf, "documents"), "doc_id", ["text"])
    return store


@query("bm25_search", "T3 J1", f"WITH {_POST}, q AS (SELECT term, count(*) AS df FROM post WHERE term IN ('with', 'this', 'erth') GROUP BY 1) SELECT id, score FROM (SELECT id, round(sum({_BM}), 6) AS score, count(*) AS n FROM post JOIN q USING (term) GROUP BY 1) WHERE n = 3 ORDER BY score DESC, id LIMIT 50")
def _(spark, sf):
    hits = X.best_matches(_document_index(spark, sf), "this with ERTH", 50)
    return W.first_rows(hits.withColumn("score", F.round("score", 6)), [F.desc("score"), F.asc("id")], 50)


@query("index_after_updates", "T2 T3", f"WITH w AS (SELECT doc_id AS id, CASE WHEN source = 'src1' THEN ['changed', 'text', 'with', 'this'] ELSE {_TERMS.format(e='text')} END AS t FROM documents WHERE source <> 'src2'), "
       f"post AS (SELECT term, id, n AS doc_len, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM w) GROUP BY 1, 2, 3), q AS (SELECT term, count(*) AS df FROM post WHERE term IN ('with', 'this') GROUP BY 1) SELECT id, score FROM (SELECT id, round(sum({_BM}), 6) AS score, count(*) AS n FROM post JOIN q USING (term) GROUP BY 1) WHERE n = 2 ORDER BY score DESC, id LIMIT 40")
def _(spark, sf):
    """One run changes the rows of a source, one removes another; the stored blocks of all other rows stay as they were."""
    docs = table(spark, sf, "documents")
    store = Store(spark, f"{work_dir(spark)}/search-{uuid.uuid4().hex}")
    X.update_index(store, 0, docs, "doc_id", ["text"])
    X.update_index(store, 1, docs.where("source = 'src1'").select("doc_id", F.lit("changed text with this").alias("text")), "doc_id", ["text"])
    X.update_index(store, 2, docs.limit(0), "doc_id", ["text"], removed=docs.where("source = 'src2'"))
    hits = X.best_matches(store, "with this", 40)
    return W.first_rows(hits.withColumn("score", F.round("score", 6)), [F.desc("score"), F.asc("id")], 40)


@query("filtered_search", "T3 J1 W10 W11", with_places(f", w AS (SELECT seq AS id, {_TERMS.format(e='''concat_ws(' ', name, coalesce(description, ''), area, array_to_string(tags, ' '))''')} AS t FROM places), post AS (SELECT term, id, n AS doc_len, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM w) GROUP BY 1, 2, 3), q AS (SELECT term, count(*) AS df FROM post WHERE term IN ('jazz', 'bar') GROUP BY 1) "
       f"SELECT seq, city, round(score, 6) AS score FROM (SELECT id AS hit, sum({_BM}) AS score, count(*) AS n FROM post JOIN q USING (term) GROUP BY 1) JOIN places ON seq = hit WHERE n = 2 AND city = 'bangkok' AND list_has_any(flags, ['jazz_blues'])"))
def _(spark, sf):
    df = places(spark, sf)
    args = ("seq", ["name", "description", "area"], ["tags"])
    hits = T.match_all(T.build_postings(df, *args), T.collection_size(df, *args), "jazz bar")
    kept = P.any_flag(P.equal_to(df, city="bangkok"), ["jazz_blues"])
    return kept.join(hits.withColumnRenamed("id", "seq"), "seq").select("seq", "city", F.round("score", 6).alias("score"))


@query("flag_search", "T4 P2", with_places("SELECT seq FROM places WHERE city = 'bangkok' AND list_has_any(flags, ['rooftop', 'cinema']) ORDER BY quality_score DESC, seq LIMIT 50"))
def _(spark, sf):
    df = P.any_flag(P.equal_to(places(spark, sf), city="bangkok"), ["rooftop", "cinema"])
    return W.rank_by(df, "quality", "seq", 50).select("seq")


def _relevance(query_text: str) -> str:
    words = query_text.lower().split()
    parts = [f"CASE WHEN {S.has('lower(name)', words)} THEN 10e0 ELSE 0e0 END", f"CASE WHEN {S.has('lower(description)', words)} THEN 5e0 ELSE 0e0 END",
             f"8e0 * len(list_filter(tags, lambda t: {S.has('lower(t)', words)}))", f"6e0 * len(list_filter(flags, lambda t: {S.has('lower(t)', words)}))"]
    for triggers, flags, tags in rules.QUERY_RULES:
        if any(t in query_text.lower() for t in triggers):
            parts += [f"CASE WHEN list_has_any(flags, {S.strs(flags)}) THEN 15e0 ELSE 0e0 END", f"CASE WHEN list_has_any(tags, {S.strs(tags)}) THEN 10e0 ELSE 0e0 END"]
    return " + ".join(parts)


@query("query_relevance", "F61", with_places(f"SELECT seq, relevance FROM (SELECT seq, {_relevance('Jazz music and street food')} AS relevance FROM places) WHERE relevance > 0 ORDER BY relevance DESC, seq LIMIT 20"))
def _(spark, sf):
    return T.rank_by_query(places(spark, sf), "Jazz music and street food", "seq").select("seq", "relevance")


@query("query_total", "F61", with_places(f"SELECT count(*) AS total FROM places WHERE {_relevance('museum gallery')} > 0"))
def _(spark, sf):
    return T.query_total(places(spark, sf), "museum gallery")
