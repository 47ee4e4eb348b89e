"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A term counts only where it stands between boundaries (no letter or digit of ASCII beside it). One strict term rejects;
soft terms reject when enough distinct ones occur. Rules name a host with all its subdomains and the start of a path;
the longest rule that fits decides, and only urls without a rule are left to the vocabulary.

Null urls and urls without ``://`` have an empty host and path, fit no rule, and are judged by the vocabulary over the
whole url (null: no term). Each input row gives one output row, repeated rows included; other columns pass through.
One pass, no shuffle; the only thing sent to tasks is the vocabulary, a parameter.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

A_Z, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Vocabulary:
    """Terms in small letters; ``soft_needed`` distinct soft terms reject."""
    strict: tuple[str, ...] = ("porn", "xxx", "sex", "hentai", "viagra", "cialis", "spam", "warez", "malware", "phishing")
    soft: tuple[str, ...] = ("cheap", "pills", "pharmacy", "casino", "poker", "betting", "bonus", "free", "download", "torrent", "crack",
                             "keygen", "escort", "nude", "adult", "dating", "loan", "loans", "payday", "replica", "farm", "win")
    soft_needed: int = 2


VOCABULARY = Vocabulary()
#: a vocabulary is sent to every task, so a table of more terms is refused
MOST_TERMS = 1_000_000


def vocabulary_of(terms: DataFrame, term: str = "term", strict: str = "strict", soft_needed: int = 2) -> Vocabulary:
    """A vocabulary from a table of (term, whether it is strict): a Parquet, CSV or other table read by Spark.

    Terms are taken in small letters (A-Z) without white space around them; null and empty ones are left out, a null mark is soft, and a term
    given both ways is strict.
    """
    word = F.trim(F.translate(F.col(term).cast("string"), A_Z, SMALL))
    rows = (terms.select(word.alias("t"), F.coalesce(F.col(strict).cast("boolean"), F.lit(False)).alias("s")).where("t != ''")
            .groupBy("t").agg(F.max("s").alias("s")).limit(MOST_TERMS + 1).collect())
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary holds at most {MOST_TERMS} terms")
    return Vocabulary(tuple(sorted(r.t for r in rows if r.s)), tuple(sorted(r.t for r in rows if not r.s)), soft_needed)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: fixed values of the query
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def url_parts(url: str) -> tuple[Column, Column]:
    """(host, path): the host runs from the first :// to / ? # or the end, A-Z lower-cased; the path on to ? # or the end."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, A_Z, SMALL), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _terms(vocabulary: Vocabulary):
    """A function of url batches giving the distinct strict and soft terms of each."""
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, terms in (("strict", vocabulary.strict), ("soft", vocabulary.soft)):
            for t in terms:
                automaton.add_word(t, (kind, t))
        automaton.make_automaton()
        edge = set("abcdefghijklmnopqrstuvwxyz0123456789")
        small = str.maketrans(A_Z, SMALL)
        for urls in batches:
            found = {"strict": [], "soft": []}
            for url in urls:
                low, hits = (url or "").translate(small), {"strict": set(), "soft": set()}
                for end, (kind, term) in automaton.iter(low):
                    start = end - len(term)
                    if (start < 0 or low[start] not in edge) and (end + 1 == len(low) or low[end + 1] not in edge):
                        hits[kind].add(term)
                for kind in found:
                    found[kind].append(sorted(hits[kind]))
            yield pd.DataFrame(found)
    return F.pandas_udf(count, "strict array<string>, soft array<string>")


def filter_urls(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` (null if none), ``strict_terms``, ``soft_terms`` and ``verdict`` (replacing columns so named)."""
    host, path = url_parts(url)
    out = df.withColumns({"host": host, "path": path})
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # later, longer rules stand outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, by_rule = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(by_rule)
    out = out.withColumns({"rule": rule, "_terms": _terms(vocabulary)(F.col(url))})
    bad = (F.size("_terms.strict") > 0) | (F.size("_terms.soft") >= vocabulary.soft_needed)
    return out.withColumns({"strict_terms": F.col("_terms.strict"), "soft_terms": F.col("_terms.soft"),
                            "verdict": F.coalesce(by_rule, F.when(bad, "block").otherwise("allow"))}).drop("_terms")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", F.concat_ws(",", "strict_terms").alias("strict_terms"),
        F.concat_ws(",", "soft_terms").alias("soft_terms"))


def _list_sql(terms: tuple[str, ...]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}' END" for t in sorted(terms))
    return f"concat_ws(',', {cases})"


def _rule_sql(what: str) -> str:
    arms = []
    for r in sorted(RULES, key=lambda r: -len(r.text)):
        arms.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'")
    return "CASE " + " ".join(arms) + " END"


SQL = f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{A_Z}', '{SMALL}') AS low,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{A_Z}', '{SMALL}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {_list_sql(VOCABULARY.strict)} AS strict_terms, {_list_sql(VOCABULARY.soft)} AS soft_terms FROM b)
SELECT page_id, host, path, {_rule_sql('text')} AS rule,
       coalesce({_rule_sql('verdict')}, CASE WHEN strict_terms <> '' OR len(string_split(soft_terms, ',')) >= {VOCABULARY.soft_needed}
         THEN 'block' ELSE 'allow' END) AS verdict, strict_terms, soft_terms FROM c
"""
