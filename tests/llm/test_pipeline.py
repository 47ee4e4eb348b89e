"""The stages one after the other on the smallest tables, each result held against a plain reading of its promise."""
import re

import corpus_pipeline
from placewright.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = [texts(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = out
        kept.append(texts(docs))
    start, quality, lines, near, clean = kept
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    wrong = [d for d, q in labels.items() if d in start and (d in quality) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)
    assert set(clean) <= set(near) <= set(lines) <= set(quality) <= set(start)
    long = [x for t in lines.values() for x in (t or "").split("\n") if len(x) >= 40]
    assert len(long) == len(set(long))
    assert {x for t in quality.values() for x in (t or "").split("\n") if len(x) < 40 and x} >= {x for t in lines.values() for x in t.split("\n") if len(x) < 40 and x}

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = {d: shingles(t) for d, t in lines.items()}

    def alike(a, b):
        return sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(alike(a, b) for a in near for b in near if a < b)
    assert all(any(alike(d, other) for other in lines if other < d) for d in set(lines) - set(near))

    find = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = find(r.text)
        windows |= {" ".join(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    hit = {d for d, t in near.items() if any(f" {x} " in f" {' '.join(find(t))} " for x in windows)}
    assert set(clean) == set(near) - hit
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in coded} == set(clean) and all(r.parity and r.round_trip and r.n_tokens == len(r.ids) for r in coded)
