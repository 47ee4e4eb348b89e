"""Each operator against brute force or a round trip, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import (chat_format, decontaminate, factor_machine, hyper_minhash, line_dedup, line_rules, repeated_spans, sentence_pieces,
                             string_kernel, url_filter)
from placewright.llm.words import ALNUM_LOWER, WHITE, WHITE_LOWER, Words, spans_hash

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = re.compile("[^\x20\x09-\x0D]+")


def words(rng, n, size=4000):
    """Words of letters, as line rules read all numbers as one."""
    names = (rng.randrange(size) for _ in range(n))
    return " ".join("w" + "".join(chr(97 + k // 20 ** j % 20) for j in range(4)) + "é" for k in names)


def frame(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in enumerate(texts)], DOC)


def hard_texts(rng):
    """Null, empty, blank, short, long and repeated texts."""
    base = words(rng, 300)
    return [None, "", " \n\t ", "one", "two words", base, base, base + " end", "x" * 5000, words(rng, 20000), "é" * 300 + "\n" + "é" * 300]


def test_words_agree_with_a_plain_reading():
    texts = ["Ab  c\té\x0bz", "", "Ünï CODE 9a", "a\n\nb", "\x1fq\x85r"]
    for pattern, table, low in (("[^\x20\x09-\x0D]+", WHITE, False), ("[^\x20\x09-\x0D]+", WHITE_LOWER, True),
                                ("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ALNUM_LOWER, True)):
        w = Words([t.encode() for t in texts], table)
        got = [[w.word(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        small = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t) if low else t
        assert got == [re.findall(pattern, small(t)) for t in texts]
    data = np.frombuffer(b"abcabc", np.uint8)
    h = spans_hash(data, np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]


def test_urls(spark):
    urls = ["http://a.example.ORG/es/x", "http://example.org/en/15", "http://x.org", "http://b.com/fr/1?q", "https://c.com/de/#f", None, "no scheme",
            "http://spam.net/a", "http://spammer.net/a", "http://cheap-pills.net/", "http://cheapest.net/pills", "http://myorg/", "ftp://ORG/", "://", ""]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls[:1])], "page_id bigint, url string, host string")
    out = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/15", "example.org/en/1", "block"), ("x.org", "", None, "allow"),
        ("b.com", "/fr/1", "com/fr/", "allow"), ("c.com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("spam.net", "/a", None, "block"), ("spammer.net", "/a", None, "allow"), ("cheap-pills.net", "/", None, "block"),
        ("cheapest.net", "/pills", None, "allow"), ("myorg", "/", None, "allow"), ("org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow")]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_line_rules(spark):
    rng = random.Random(1)
    shared = "Shared  notice no 12 of this site"
    texts = hard_texts(rng) + [f"{shared}\n{words(rng, 60)}\nsHared notice no 7 of this  site" for _ in range(25)] + [
        "\n".join([shared] * 20) + f"\n{words(rng, 3)}" for _ in range(2)]
    out = {r.doc_id: r for r in line_rules.line_rules(frame(spark, texts, None).unionByName(frame(spark, texts, "b").limit(1))).where("source is null").collect()}
    for i, t in enumerate(texts):
        w = SPACE.findall(t or "")
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 2 * len(again) > len(w))
    assert {(out[i].removed_words, out[i].kept) for i in range(11, 36)} == {(14, True)}
    assert out[36].removed_words == 140 and not out[36].kept and out[10].n_dup_lines == 1
    assert line_rules.line_rules(frame(spark, ["a"]).limit(0)).count() == 0


def test_frequent_lines_are_removed_from_the_text(spark):
    rng = random.Random(13)
    own = [words(rng, 60) for _ in range(25)]
    texts = hard_texts(rng) + [f"Site  notice no {d}\n\n{t}\nsite notice no 7" for d, t in enumerate(own)] + ["site notice no 1"]
    docs = frame(spark, texts, None)
    out = {r.doc_id: r for r in line_rules.clean_lines(docs).collect()}
    assert [out[d].text for d in range(len(texts))] == texts[:11] + [f"\n{t}" for t in own] + [""]
    assert {d: r.removed_words for d, r in out.items()} == {r.doc_id: r.removed_words for r in line_rules.line_rules(docs).collect()}
    assert {out[d].removed_words for d in range(11, 36)} == {8} and out[36].removed_words == 4


def test_decontamination(spark):
    rng = random.Random(2)
    items = [words(rng, 25, 300), words(rng, 10, 300), words(rng, 4, 300), "", None, words(rng, 25, 300)]
    base = [words(rng, 120, 300) for _ in range(12)]
    cut = items[0].split()
    texts = hard_texts(rng) + base + [base[0] + " " + " ".join(cut[3:14]).upper().replace("É", "é") + ", " + base[1], items[1], items[2] + "!", " ".join(cut[:9]), items[5] * 2]
    tests = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items + items[:1])], "item_id bigint, text string, n_words string")
    find = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {(i, tuple(w[k:k + 10])) for i, w in enumerate(map(find, items + items[:1])) if w for k in range(max(1, len(w) - 9))}
    out = {r.doc_id: r for r in decontaminate.contamination(frame(spark, texts), tests).withColumn("n_hit", decontaminate.covered(F.col("spans"))).collect()}
    assert len(out) == len(texts)
    for d, t in enumerate(texts):
        w, hit, ids = find(t), set(), set()
        for i, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(str(i))
        assert (out[d].n_words, out[d].n_hit, out[d]["items"]) == (len(w), len(hit), sorted(ids)), d
    none = decontaminate.contamination(frame(spark, texts), tests.limit(0))
    assert none.where(F.size("spans") > 0).count() == 0 and none.count() == len(texts)
    assert decontaminate.contamination(frame(spark, ["a"]).limit(0), tests).count() == 0


def test_short_items_are_found_inside_long_texts(spark):
    rng = random.Random(12)
    long = words(rng, 200, 300).split()
    texts = [" ".join([*long[:70], "Solo", *long[70:]]), " ".join([*long, "a", "PAIR"]), " ".join(["a", "b", "c", "d", *long]), " ".join(long), "solo", "a b c",
             " ".join([*long[:9], "a", "b", "c", *long[9:20], "a", "b", "c"]), None]
    items = [(0, "solo"), (1, "a pair"), (2, "a b c d"), (3, "a b c"), (4, "pair a")]
    out = {r.doc_id: r for r in decontaminate.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"))
           .withColumn("n_hit", decontaminate.covered(F.col("spans"))).collect()}
    assert {d: (r.n_hit, r["items"]) for d, r in out.items()} == {0: (1, ["0"]), 1: (2, ["1"]), 2: (4, ["2", "3"]), 3: (0, []), 4: (1, ["0"]), 5: (3, ["3"]),
                                                                6: (6, ["3"]), 7: (0, [])}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, k):
    for _ in range(k):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + rng.choice("abé") + s[i:], s[:i] + s[i + 1:], s[:i] + rng.choice("abé") + s[i + 1:]])
    return s


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(38, 70))) for _ in range(12)]
    texts = hard_texts(rng) + ["\n".join(edited(rng, rng.choice(lines), rng.randint(0, 4)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    docs = frame(spark, texts).withColumn("line", F.lit(1)).withColumn("removed", F.lit(True))
    got = {r.id: r.lines for r in line_dedup.removed_lines(docs).collect()}
    seen, expect = [], {}
    for d, t in enumerate(texts):
        for at, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line) >= 40:
                if any(abs(len(x) - len(line)) <= 2 and (x == line or len(line) < 200 and distance(x, line) <= 2) for x in seen):
                    expect.setdefault(d, []).append(at)
                seen.append(line)
    assert got == expect
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert all(out[d] == (t if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in expect.get(d, []))) for d, t in enumerate(texts))
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.removed_lines(docs.limit(0)).count() == 0


def shuffled(spark, action):
    """Bytes of shuffle that the stages of an action write."""
    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}
    before = stages()
    action()
    return sum(n for k, n in stages().items() if k not in before)


def test_line_dedup_shuffles_names_and_keys(spark):
    """Texts of lines that have no near copy stay where they are, and a line has few keys whatever the table's size."""
    rng = random.Random(31)
    texts = ["\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé ", k=1500)) for _ in range(4)) for _ in range(300)]
    docs = frame(spark, texts)
    assert shuffled(spark, lambda: line_dedup.removed_lines(docs).collect()) < 0.5 * sum(len(t) for t in texts)


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_line_keys_meet(spark, errors):
    """Lines within the distance share a key that one of them owns, also over the bounds of length classes."""
    rng = random.Random(errors)
    pairs = []
    for n in [4 * errors, 31, 32, 33, 34, *range(40, 50), 63, 64, 65, 127, 128, 129, 130, 131, 159, 160, 161, 162, 163, 300]:
        for _ in range(12):
            a = "".join(rng.choice("abcdefgé") for _ in range(n))
            b = a
            for _ in range(errors):  # edits at the ends count as well
                i = rng.choice([0, len(b) - 1, rng.randrange(len(b))])
                b = rng.choice([b[:i] + "x" + b[i:], b[:i] + b[i + 1:], b[:i] + "x" + b[i + 1:], b + "x"])
            pairs.append((a, b))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.keys_of("a", errors).alias("x"), line_dedup.keys_of("b", errors).alias("y")).collect()
    for r in rows:
        x, y = (set(k for k in keys if k is not None) for keys in (r.x, r.y))
        assert x & set(r.y[:errors + 1]) or y & set(r.x[:errors + 1]), (r.a, r.b)
    if errors == 2:
        assert max(sum(k is not None for k in keys) for r in rows for keys in (r.x, r.y) if len(r.a) >= 40) <= 10


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_banded_distance(spark, errors):
    rng = random.Random(errors)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4 * errors, 30)))
        pairs.append(sorted((a, edited(rng, a, rng.randint(0, 5))), key=len))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", line_dedup.within_edits(F.split("a", ""), F.split("b", ""), errors).alias("ok")).collect()
    assert all(r.ok == (distance(r.a, r.b) <= errors) for r in got)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = factor_machine.op5_factor_machine(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert out.where("predicted = quality").count() >= 0.97 * out.count()
    docs = frame(spark, hard_texts(random.Random(4))).withColumn("score", F.lit("x"))
    none = factor_machine.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in factor_machine.score_texts(docs, none).collect()} == {0.5}
    assert factor_machine.score_texts(docs.limit(0), none).count() == 0


def test_interactions_are_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = factor_machine.Machine(0.5, rng.normal(size=factor_machine.WIDTH), rng.normal(size=(factor_machine.WIDTH, 3)))
    x = np.zeros((1, factor_machine.WIDTH))
    at = rng.choice(factor_machine.WIDTH, 6, replace=False)
    x[0, at] = rng.normal(size=6)
    pairs = sum(x[0, i] * x[0, j] * (m.factors[i] @ m.factors[j]) for k, i in enumerate(at) for j in at[k + 1:])
    assert np.isclose(m.raw(x)[0], 0.5 + x[0] @ m.weights + pairs)


def test_chats(spark):
    says = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a <|x|> b\\", "", None, "<", "|im_end|>", "é\n\n<|im_start|>user\nhi<|im_end|>\n", "x" * 9000]
    roles = ["user", "assistant", "assistant", None, "sys%tem", "a\nb", "<|im_end|>", "%0A", "assistant"]
    rows = [(c, k, roles[(k + c) % 9], says[(k * 2 + c) % 9], "z") for c in range(9) for k in range(7)] + [(None, None, "user", "x", "z")] * 2 + [
        (50, k, "assistant", f"t{k}", "z") for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat_format.format_chats(df).withColumn("loss", chat_format.loss_text()).collect()
    assert len(out) == 11
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in out:
        source = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=key)]
        assert [(t.role, t.text) for t in r.turns] == source
        assert r.loss == "".join(t for who, t in source if who == "assistant")
        assert "<|im_start|>" not in "".join(r.formatted[s.start:s.start + s.length] for s in r.loss_spans) or not r.escaped
    assert chat_format.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeated_spans(spark, crowd):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    p, q = text(230), text(199)
    texts = hard_texts(rng)[:9] + [text(400) + p + text(50), text(3) + p[10:] + text(300), q + text(100), q + text(120), "ab" * 300, p, text(150) + p[:205] + "é",
                                   text(900)] + [p[k:] + text(40) for k in range(0, 40, 7)]
    texts.append(texts[-1])
    docs = frame(spark, texts).withColumn("row", F.lit(0)).withColumn("spans", F.lit("s"))
    got = {r.doc_id: r for r in repeated_spans.remove_repeats(docs, crowd=crowd).collect()}
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i:i + 200] for t in raw for i in range(len(t) - 199))
    for d, t in enumerate(raw):
        hit = [False] * len(t)
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1:
                hit[i:i + 200] = [True] * 200
        kept = bytes(b for b, h in zip(t, hit) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256, bytes(got[d].kept)) == (
            len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest(), kept), d
    assert repeated_spans.remove_repeats(docs.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [words(rng, rng.randint(30, 200)) for _ in range(8)]
    texts = hard_texts(rng)
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(w))
    docs = frame(spark, texts).withColumn("component", F.lit(0)).withColumn("n", F.lit(0))
    got = {r.doc_id: r for r in hyper_minhash.near_duplicates(docs, words=4).collect()}
    sets = []
    for t in texts:
        w = SPACE.findall((t or "").lower())
        sets.append({tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in range(len(texts))):
            break
    assert [(got[d].n_shingles, got[d].component_id, got[d].kept) for d in range(len(texts))] == [(len(s), label[d], label[d] == d) for d, s in enumerate(sets)]
    assert hyper_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_small_sets_are_not_lost_in_open_buckets(spark):
    """The seeds give texts whose only link, 4 of 5 words, is met in an open bucket with more than 54 unequal low bits."""
    texts = [" ".join(f"w{seed}x{c}" for c in own) for seed in (3368, 8759, 17478) for own in ("01235", "0123", "01234", "012356", "012357", "012358")]
    got = {r.doc_id: r.component_id for r in hyper_minhash.near_duplicates(frame(spark, texts), words=1).collect()}
    assert got == {d: d // 6 * 6 for d in range(len(texts))}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for n, shared in ((400, 360), (2000, 1500)):
        found = []
        for _ in range(40):
            all_ = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
            a, b = all_[:n], all_[n - shared:]
            ra, rb = (hyper_minhash.registers(x, np.zeros(len(x), np.int64), 1) for x in (a, b))
            found.append(hyper_minhash.estimate(ra, rb, np.array([n]))[0])
        assert abs(np.mean(found) - shared / (2 * n - shared)) < 0.03


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["idiot", "moron", "scum", "loser", "pathetic"]
    texts, labels = [], []
    for d in range(400):
        w = words(rng, rng.randint(20, 80), 300).split()
        toxic = d % 4 == 0
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((d, int(toxic)))
    machine = string_kernel.train(frame(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    told = ["you idiot there", "you i-d-i-o-t there", "you i d i o t there", "you idxiot there", "MORON!", "w1é w2é w3é"] + hard_texts(rng)
    out = {r.doc_id: r.score for r in string_kernel.score_texts(frame(spark, told).withColumn("margin", F.lit("m")), machine).collect()}
    assert all(out[d] >= 0.7 for d in range(5))
    assert not {(told[d] or "")[:20]: s for d, s in out.items() if d >= 5 and s >= 0.5}
    none = string_kernel.train(frame(spark, texts), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.score for r in string_kernel.score_texts(frame(spark, told), none).collect()} == {0.5}
    assert string_kernel.score_texts(frame(spark, told).limit(0), machine).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = string_kernel.op9_string_kernel(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert out.where("predicted = toxic").count() >= 0.9 * out.count()


def test_sentence_pieces_decodes_odd_units_only():
    """Units are the words of a text, and only those whose pieces do not spell them are decoded, each as the backend decodes it."""
    with open(sentence_pieces.default_model(), "rb") as f:
        backend = sentence_pieces.Backend(sentence_pieces.read_model(f.read()))
    mark = sentence_pieces.MARK
    for t in ["", " ", "a", " a", "a ", "a  b c", "a b", f"a {mark}b", f"{mark}", "a\nb\tc d", "<0x41> <unk> é 𝄞", "  "]:
        assert backend.marked and [mark + k for k in backend.keys(t)] == backend.units(backend.normalise(t))
    units = [mark + u for u in ("plain", "words", "<0x41>", "<unk>", "<s>", "é𝄞", "\u0378", "a\x00b", f"{mark}x", "")]
    ids, asked = backend.encode(units), []
    decode = {u: backend.tokenizer.decode(a, skip_special_tokens=False) for u, a in zip(units, ids)}

    class Counting:
        def decode_batch(self, batch, **how):
            asked.extend(batch)
            return inner.decode_batch(batch, **how)
    inner, backend.tokenizer = backend.tokenizer, Counting()
    assert backend.altered(units, ids) == {u: t for u, t in decode.items() if t != u.replace(mark, " ")}
    assert len(asked) < len(units) / 2


def test_sentence_pieces(spark):
    import sentencepiece
    texts = hard_texts(random.Random(8)) + ["  a  b ", "▁ y▁", "日本 🎉\tz\n\n q", "<s> </s> <unk> <0x0A>", "a ", "1234 5", "\u0000x"]
    other = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    coded = sentence_pieces.encode_texts(frame(spark, texts).withColumn("ids", F.lit(0)))
    out = {r.doc_id: r for r in coded.collect()}
    assert all(list(out[d].ids) == other.encode(t or "") and out[d].parity and out[d].round_trip for d, t in enumerate(texts))
    back = {r.doc_id: r.text for r in sentence_pieces.decode_texts(coded).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in enumerate(texts))
    assert sentence_pieces.encode_texts(frame(spark, ["a"]).limit(0)).count() == 0


def test_flags_compare_whole_texts(spark, tmp_path):
    """A model that squeezes blanks does not give them back, so round_trip is false where blanks are lost."""
    with open(sentence_pieces.default_model(), "rb") as f:
        data = f.read()
    path = tmp_path / "squeeze.model"
    path.write_bytes(data + bytes([0x1A, 2, 0x20, 1]))  # normaliser flag 4: white space is squeezed
    texts = ["a b", "a  b", " a b", "", "a b ", None]
    assert sentence_pieces.read_model(path.read_bytes()).squeeze
    out = {r.doc_id: r for r in sentence_pieces.encode_texts(frame(spark, texts), model_path=str(path)).collect()}
    assert [out[d].round_trip for d in range(len(texts))] == [True, False, False, True, False, True]
    assert all(r.parity for r in out.values())


def test_unigram_model_is_rebuilt():
    """A small hand-made unigram model with byte fallback, serialised as the format has it."""
    import struct

    import sentencepiece

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [
        ("▁", -3.0, 1), ("▁he", -2.0, 1), ("llo", -2.5, 1), ("l", -4.0, 1), ("o", -4.0, 1), ("h", -5.0, 1), ("e", -5.0, 1), ("▁hel", -3.1, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    data += field(2, 2, field(3, 0, b"\1") + bytes([0x98, 0x02, 1])) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\1") + field(4, 0, b"\0"))
    model = sentence_pieces.read_model(data)
    assert model.kind == sentence_pieces.UNIGRAM and model.byte_fallback and model.dummy_prefix and not model.squeeze
    backend = sentence_pieces.Backend(model)
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in ("hello", "hello  hello", "heé lo"):
        ids = [i for u in backend.encode(backend.units(backend.normalise(t))) for i in u]
        assert ids == other.encode(t) and backend.decode(ids) == t
