"""Conversation repair, top-k search and filter audit against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""
import hashlib
import heapq
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewright.llm import filter_audit, knn_join, turn_repair

WORD = re.compile("[^\x20\x09-\x0D]+")
CHAT = "conv_id bigint, turn bigint, role string, text string"
BIG = 2 ** 53 + 1


def chat_frame(spark, rows, ddl=CHAT):
    return spark.createDataFrame(rows, ddl)


def plain_repair(rows):
    """Cheapest edits by Dijkstra over (rows read, state), ties by the audit so far."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, r, x in rows:
        said = "".join(WORD.findall(x))
        faults.append("blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((r, x))
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        last = roles[-1:]
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        want = "a" if last == "u" else "u"
        name = {"a": "assistant", "u": "user"}[want]
        heapq.heappush(heap, (cost + 3, audit + "I", i, want, (*lines, f"{name}:")))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if r[:1] == want or (r[:1] == "s" and not last):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, r[0], (*lines, f"{r}:{x}")))
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, want, (*lines, f"{name}:{x}")))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hard_chats(rng):
    texts = ["Hello.", "What?", "no end", "", "  \t", None, "é!", "Hello.", "a\nb.", "x" * 3000 + ".", ".", "cut \n"]
    roles = ["user", "assistant", "system", "tool", "", None, "assistant", "user"]
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"fine {t}.") for t in range(8)]
    rows += [(2, None, "user", "same."), (2, None, "user", "same."), (2, 3, "assistant", "same."), (2, 3, "assistant", "same.")]
    rows += [(None, 0, "system", "Be kind."), (None, 1, "system", "Be kind, too."), (BIG, 5, None, None), (BIG - 1, 5, "assistant", "only.")]
    for c in range(10, 70):
        rows += [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 14))]
    return rows


@pytest.mark.parametrize("width", [None, 2, 5])
def test_turn_repair(spark, width):
    rng = random.Random(11)
    rows = hard_chats(rng)
    rng.shuffle(rows)
    edited = turn_repair.repair(chat_frame(spark, rows), width=width)
    out = {r[0]: tuple(r[1:]) for r in turn_repair.summaries(edited).collect()}
    assert out == {c: plain_repair([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    if width is None:
        turns = turn_repair.repaired_turns(edited).orderBy("pos", "nth").collect()
        for c, told in out.items():
            mine = [r for r in turns if r.conv_id == c]
            assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine))
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == told[-1]


def test_turn_repair_of_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["yes.", "no", f"text {t}.", ""])) for t in range(1500)]
    edited = turn_repair.repair(chat_frame(spark, rows).repartition(3), width=64)
    assert [tuple(r[1:]) for r in turn_repair.summaries(edited).collect()] == [plain_repair(rows)]


def test_turn_repair_of_nothing_and_clashing_columns(spark):
    empty = chat_frame(spark, [])
    assert turn_repair.summaries(turn_repair.repair(empty)).count() == 0
    ddl = CHAT + ", pos string, code string, at string, edit string, place int, h string"
    rows = [(1, 0, "user", "Hi.", "p", "c", "a", "e", 1, "h"), (1, 1, "assistant", "Yes.", "p", "c", "a", "e", 1, "h")]
    assert [tuple(r)[-2] for r in turn_repair.summaries(turn_repair.repair(chat_frame(spark, rows, ddl))).collect()] == ["KK"]


def test_damage(spark):
    rows = [(c, t, "assistant", "Said. Done!") for c in range(40) for t in [None, 0, 1, 2]] + [(None, 0, None, None)]
    import zlib
    want = []
    for c, t, r, x in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        want += [] if lot == 0 else [(c, t, "user" if lot == 4 else r, "" if lot == 1 else re.sub("[.!?]", "", x) if lot == 2 else x)] * (2 if lot == 3 else 1)
    got = [tuple(r) for r in turn_repair.damage(chat_frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_top(rows, asked, k=5):
    whole = [(n, i, [int(x) for x in v]) for n, (i, v) in enumerate(rows)]
    width = max(len(v) for _, _, v in whole)
    whole = [(n, i, v + [0] * (width - len(v))) for n, i, v in whole]
    out = []
    for n, i, v in whole:
        if i is not None and asked(i):
            best = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m) for m, j, w in whole if m != n))[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("deal", [{}, {"pivots": 3, "group": 2, "slice_rows": 1}, {"pivots": 40, "group": 7}])
def test_knn_join(spark, deal):
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (6, 5))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.integers(-20, 20, 5)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(BIG, rows[3][1]), (BIG - 1, rows[3][1]), (None, rows[3][1]), (50, rows[9][1]), (-50, [1.0]), (200, [])]
    frame = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(5)
    got = knn_join.top_products(frame, F.col("id") % 50 == 0, **deal)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_top(rows, lambda i: i % 50 == 0)


def test_knn_join_prunes_clusters_and_keeps_every_row():
    """Far cells are left out by their summaries, and no best row is among what is left out."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (200, 4)) + 1000 * np.eye(4)[c] for c in range(4)])
    cells = knn_join.Cells(x[[0, 200, 400, 600]])
    cell, far = cells.nearest(x)
    cells.radius = np.array([far[cell == c].max() for c in range(4)])
    sure = np.sort(cells.least(x), axis=1)[:, -6]
    cells.bound(cells.radius, sure, cells.radius)
    assert cells.wanted.sum() == 4 and (cells.wanted == np.eye(4, dtype=bool)).all()
    may = cells.may(x, cell)
    for q in range(0, 800, 50):
        s = x @ x[q]
        s[q] = -np.inf
        assert may[cell[q], np.argsort(-s)[:5]].all()


def test_knn_join_large_numbers_and_nothing(spark):
    big = [(0, [2.0 ** 40, 3.0]), (1, [2.0 ** 20 + 1, 1.0]), (2, [2.0 ** 20, 5.0]), (3, [-1.0, 0.0])]
    frame = spark.createDataFrame(big, "id bigint, v array<double>")
    got = knn_join.top_products(frame, F.col("id") == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_top(big, lambda i: i == 0)
    assert knn_join.top_products(frame.limit(0), F.col("id") == 0).count() == 0
    assert knn_join.top_products(frame, F.col("id") == 77).count() == 0
    raw = spark.createDataFrame([(0, [1.0, None]), (1, None), (2, [float("nan")]), (3, [float("inf")]), (4, [1.5, -2.0])], "vec_id bigint, embedding array<float>")
    assert [r.id for r in knn_join.clean(raw, "vec_id", "embedding").collect()] == [4]
    clash = raw.withColumn("v", F.lit("x")).withColumn("id", F.lit("y")).withColumn("row", F.lit(1))
    assert [tuple(r) for r in knn_join.clean(clash, "vec_id", "embedding").collect()] == [(4, [1.5, -2.0])]


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    seen = {}
    for d, t, *_ in docs:
        if d is not None:
            seen[t or ""] = min(d, seen.get(t or "", d))
    rows = []
    for d, t, lang, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > seen[t]}
        rows.append((lang or "", {f for f, hit in fails.items() if hit}, d in good and d is not None, d in toxic and d is not None))
    out = []
    for part in {r[0] for r in rows}:
        mine, made = [r for r in rows if r[0] == part], []
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                before = set(order[:i])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                made.append([part, "".join(order), i + 1, sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine),
                             sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        total = {f: sum(r[4] for r in made if r[-1] == f) for f in "ABCDE"}
        out += [(*r[:-1], total[r[-1]]) for r in made]
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(2)
    names = ["alpha", "Beta", "GAMMA", "d#lta", "é", "zeta", "100%"]
    texts = [None, "", " \n ", "A B", "é" * 50, "#", "x" * 4000, " ".join(f"w{i}" for i in range(20000))]
    texts += [" ".join(rng.choice(names) + str(rng.randrange(rng.choice([5, 400]))) for _ in range(rng.randrange(80, 160))) for _ in range(40)]
    docs = [(i, t, rng.choice(["en", "de", None, ""]), "s", 0) for i, t in enumerate(texts)]
    docs += [(100 + i, rng.choice(texts), rng.choice(["en", "de"]), "s", 0) for i in range(60)]
    docs += [(None, texts[9], "en", "s", 0), (None, "", None, "s", 0), (5, texts[12], "en", "s", 0), (BIG, texts[12], "en", "s", 0), (BIG - 1, texts[13], "fr", "s", 0)]
    docs += [docs[10]] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160)] + [(3, 1, 0), (None, 1, 1), (BIG, 1, 1)]
    frame, told = spark.createDataFrame(docs, DOC).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want = plain_audit(docs, labels)
    for width in (filter_audit.RANGE, 3):
        lists = filter_audit.posting_lists(filter_audit.judged(frame, told), width=width)
        assert sorted(tuple(r) for r in filter_audit.audit(filter_audit.merged_sizes(lists)).collect()) == want
    clash = frame.withColumn("id", F.lit("x")).withColumn("h", F.lit(1)).withColumn("A", F.lit("y")).withColumn("part", F.lit(2))
    clash_told = told.withColumn("part", F.lit(3)).withColumn("good", F.lit("z"))
    got = filter_audit.audit(filter_audit.merged_sizes(filter_audit.posting_lists(filter_audit.judged(clash, clash_told))))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert filter_audit.audit(filter_audit.merged_sizes(filter_audit.posting_lists(filter_audit.judged(frame.limit(0), told)))).count() == 0
    unlabelled = filter_audit.audit(filter_audit.merged_sizes(filter_audit.posting_lists(filter_audit.judged(frame, told.limit(0)))))
    assert sorted(tuple(r) for r in unlabelled.collect()) == plain_audit(docs, [])


def test_sorted_lists():
    rng = random.Random(4)
    for _ in range(200):
        sets = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(rng.randrange(1, 5))]
        a, *rest = arrays = [np.array(s, np.int64) for s in sets]
        assert filter_audit.union(arrays).tolist() == sorted(set().union(*sets))
        for b, s in zip(rest, sets[1:]):
            assert filter_audit.difference(a, b).tolist() == sorted(set(sets[0]) - set(s))
            assert filter_audit.shared(a, b) == len(set(sets[0]) & set(s))
