"""The stored search index against plain BM25, over updates, removals, rebuilds and lost runs."""
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from placewright.operators import search_index as X
from placewright.sources.store import Store


def plain(texts, query, top):
    """Best (id, score) by a reading of all texts; more than ``top`` where the last scores are equal."""
    words = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    terms = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    average = sum(map(len, terms.values())) / len(terms)
    df = {w: sum(w in t for t in terms.values()) for w in words}
    out = []
    for i, t in terms.items():
        count = Counter(t)
        if words and all(count[w] for w in words):
            out.append((sum(math.log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5)) * count[w] * 2.2 / (count[w] + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in words), i))
    out.sort(key=lambda x: (-x[0], x[1]))
    return [(i, round(s, 9)) for s, i in out[:top]]


def found(store, query, top, **how):
    hits = X.best_matches(store, query, top, **how).orderBy(F.desc("score"), "id").limit(top).collect()
    return [(r.id, round(r.score, 9)) for r in hits]


QUERIES = ("alpha", "alpha beta", "beta gamma delta", "Rare alpha", "alpha nothing", "", "alpha alpha")


def make(rng, n, start=0):
    names = ["alpha"] * 8 + ["beta"] * 4 + ["gamma", "delta", "rest", "more"]
    return {start + i: " ".join(rng.choice(names) for _ in range(rng.randrange(0, 60))) + (" rare" if i % 97 == 5 else "") for i in range(n)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, body string")


def test_best_matches_and_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SLOT_ROWS", 16)
    rng, store = random.Random(1), Store(spark, str(tmp_path / "s"), buckets=8)
    texts = make(rng, 600) | {10 ** 6: None, 2 ** 53 + 1: "alpha beta"}
    X.update_index(store, 0, frame(spark, texts), "id", ["body"])
    for q in QUERIES:
        assert found(store, q, 20, first_slots=2) == plain(texts, q, 20), q
    new = make(rng, 40, 580) | {3: "beta beta beta"}
    before = [p["path"] for p in store.state()["tables"]["postings"]["parts"]]
    X.update_index(store, 1, frame(spark, new), "id", ["body"])
    X.update_index(store, 1, frame(spark, {0: "replayed"}), "id", ["body"])
    texts |= new
    X.update_index(store, 2, frame(spark, {}), "id", ["body"], removed=frame(spark, {i: "" for i in [4, 5, 9, 2 ** 53 + 1, 12345]}).select("id"))
    texts = {i: t for i, t in texts.items() if i not in (4, 5, 9, 2 ** 53 + 1)}
    assert [p["path"] for p in store.state()["tables"]["postings"]["parts"]][:len(before)] == before  # older blocks stay as they were
    assert store.state()["values"]["size"][0] == len(texts)
    for q in QUERIES:
        assert found(store, q, 20, first_slots=2) == plain(texts, q, 20), q
    X.rebuild_blocks(store, 3)
    assert not store.has("touched")
    for q in QUERIES:
        assert found(store, q, 20, first_slots=3) == plain(texts, q, 20), q


def test_a_query_reads_the_buckets_of_its_words(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=32)
    X.update_index(store, 0, frame(spark, make(random.Random(2), 200) | {i: f"w{i} alpha" for i in range(1000, 1200)}), "id", ["body"])
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    read = lambda words: files(store.read("postings", spark.createDataFrame([(w,) for w in words], "term string")))
    every = files(store.read("postings"))
    assert len(every) >= 30 and 1 <= len(read(["alpha"])) <= 2 and len(read(["alpha", "w1001", "w1002"])) <= 6


def test_an_empty_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    X.update_index(store, 0, frame(spark, {}), "id", ["body"])
    assert X.best_matches(store, "alpha", 5).count() == 0
