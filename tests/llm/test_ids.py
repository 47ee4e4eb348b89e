"""One table of awkward rows through every operator on documents and every stage: null ids, ids beyond 2^53, repeated ids, clashing names, no rows."""
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from placewright.llm import decontaminate, hyper_minhash, line_dedup, line_rules, repeated_spans, sentence_pieces
from placewright.llm.common import stored, table

BIG = 2 ** 53
SF = "/root/testdata/sf0.001"
CLASH = {"_score": "bigint", "_had": "string", "_row": "string", "_words": "string", "_t": "string", "id": "string", "row": "string", "r": "string", "key": "string",
         "place": "string", "score": "string", "component_id": "string", "kept": "string", "spans": "string"}


def awkward(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    one, two = text(80), text(90)
    rows = [(BIG, one), (BIG + 1, two), (BIG + 2, text(70)), (None, text(60)), (None, text(65)), (None, None), (7, text(75)), (7, text(85)), (9, text(55)), (9, None),
            (12, ""), (13, one + " end"), (-BIG - 1, text(95))]
    rows += [rows[8]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)
    return stored(df, "awkward"), rows


OPERATORS = {
    "op2": lambda d: line_rules.line_rules(d), "op3": lambda d: decontaminate.contamination(d, d.limit(0).select(F.col("doc_id").alias("item_id"), "text")),
    "op7": lambda d: repeated_spans.remove_repeats(d), "op8": lambda d: hyper_minhash.near_duplicates(d), "op10": lambda d: sentence_pieces.encode_texts(d),
    "decoded": lambda d: sentence_pieces.decode_texts(sentence_pieces.encode_texts(d)), "op4": lambda d: line_dedup.dedup_lines(d),
    "cleaned": lambda d: line_rules.clean_lines(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_come_back(spark, name):
    docs, rows = awkward(spark)
    clashing = docs.select("*", *[F.lit("1").cast(kind).alias(c) for c, kind in CLASH.items()])
    want = sorted((i for i, _ in rows), key=repr)
    for df in (docs, clashing):
        assert sorted((r.doc_id for r in OPERATORS[name](df).select("doc_id").collect()), key=repr) == want
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_near_duplicate_classes_keep_their_ids(spark):
    docs, _ = awkward(spark)
    got = {(r.doc_id, r.component_id) for r in hyper_minhash.near_duplicates(docs).where("n_shingles > 0 and doc_id > 9").collect()}
    assert got == {(BIG, 13), (13, 13), (BIG + 1, BIG + 1), (BIG + 2, BIG + 2)}


def test_cleaned_texts_keep_clashing_columns(spark):
    docs, _ = awkward(spark)
    clashing = docs.select("*", *[F.lit("1").cast(kind).alias(c) for c, kind in CLASH.items()])
    out = line_rules.clean_lines(clashing)
    assert out.columns == [*clashing.columns, "removed_words"]
    assert {tuple(r[c] for c in CLASH) for r in out.collect()} == {tuple(1 if k == "bigint" else "1" for k in CLASH.values())}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_decide_on_rows(spark, stage):
    docs, rows = awkward(spark)
    clashing = stored(docs.select("*", *[F.lit("1").cast(kind).alias(c) for c, kind in CLASH.items()]), "clash")
    out = stage(spark, clashing, SF)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    if stage is corpus_pipeline.line_dedup_stage:
        assert got == sorted(rows[:-1], key=repr)  # the second of two equal rows has nothing left
    elif stage is corpus_pipeline.near_duplicates:
        assert got == sorted((r for r in rows[:-1] if r[0] != BIG), key=repr)
    elif stage is corpus_pipeline.decontamination:
        assert got == sorted(rows, key=repr)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_contaminated_rows_go_by_row(spark):
    passage = table(spark, SF, "benchmark").where(F.size(F.split("text", " ")) >= 12).first().text
    docs, rows = awkward(spark)
    dirty = spark.createDataFrame([(None, passage, "en", "s", 1), (9, passage, "en", "s", 1)], docs.schema)
    out = corpus_pipeline.decontamination(spark, stored(docs.unionByName(dirty), "dirty"), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(rows, key=repr)


def test_encoding_of_all_rows(spark):
    docs, rows = awkward(spark)
    assert sorted((r.doc_id for r in corpus_pipeline.encoding(spark, docs, SF).collect()), key=repr) == sorted((i for i, _ in rows), key=repr)


def test_parity_bits_lose_no_link():
    """Two sets differ in at least as many elements as parity bits, whatever their sizes."""
    import numpy as np

    from placewright.llm.words import mix
    rng = np.random.default_rng(4)
    for n in (1, 3, 40, 700, 5000):
        a = mix(rng.integers(0, 2 ** 62, n).astype(np.uint64))
        for keep in (0, n // 2, n):
            b = np.concatenate((a[:keep], mix(rng.integers(0, 2 ** 62, n // 3 + 1).astype(np.uint64))))
            both = hyper_minhash.parities(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2)
            turned = sum(int(x).bit_count() for x in (both[0] ^ both[1]).view(np.uint64))
            assert turned <= len(np.setxor1d(a, b))
