"""Repair of conversation structure at the least cost, by a square-root checkpointed dynamic programme.

A conversation's rows are taken by turn (nulls first, ties by role and text). A row's first fault counts: blank (no character
other than ASCII white space), duplicate (role and text stand earlier in the conversation), truncated (the last such character
does not end a sentence). Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate
rows), Insert an empty user or assistant row 3; a truncated row that stays costs 3 more. The roles' initials have to read
``(s?(ua)+)?`` afterwards. Of the cheapest edits those with the ASCII-least initials are taken.

What is left to pay from a row on depends on four states alone: nothing said yet, after the system, after a user, after an
assistant. Rows get a number in their order and are cut into blocks of about the square root of all rows. A block's part of
a conversation (a segment) is folded from behind into sixteen costs, state to state; these give the cost vector at the end of
each segment, which is its checkpoint. Inside a segment vectors are again kept only at every square root of its rows, and
computed anew block by block while the walk goes forward and takes the ASCII-least edit that keeps the sum tight.

So a conversation of any length is read by many tasks; the passes over its segments hold one segment at a time. Only
``summaries``, whose hash and audit are single values of a conversation, streams the rows of one conversation
through one task. Numbered rows, segments and vectors are written to the shared folder.

Null roles and texts are one space, null ids are one conversation, null turns come first. Equal rows are told apart by their
place. Empty tables give empty results. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: rows of a block, where the square root of all rows is less
LEAST_BLOCK = 4096
#: states: nothing said, after the system, after a user, after an assistant
START, SYSTEM, USER, ASSISTANT = range(4)
#: what may follow a state: the state that a system, user, assistant or other row leads to (-1: none), and that of an inserted one
FOLLOWS = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
ADDED = (USER, USER, ASSISTANT, USER)
FAULTS = ("", "blank", "duplicate", "truncated")
FAR = 1 << 50
#: cost of ending in a state
END = (0, 2 * INSERT, INSERT, 0)
Vector = tuple[int, int, int, int]


class Costs:
    """Cost vectors from behind and the edits that keep them tight, remembered by what a row is and how the vector behind it looks."""

    def __init__(self) -> None:
        self.before: dict = {}
        self.steps: dict = {}

    @staticmethod
    def _row(code: int, state: int, v: Vector) -> list[tuple[str, int, int]]:
        """(edit, cost to the end, next state) of the edits that consume a row, ASCII-least first."""
        out = [("D", DELETE + v[state], state)]
        if code >> 2 in (0, 3):
            more, held = TRUNCATED * (code >> 2 == 3), FOLLOWS[state][code & 3]
            if held >= 0:
                out.append(("K", more + v[held], held))
            out.append(("R", REROLE + more + v[ADDED[state]], ADDED[state]))
        return out

    def back(self, code: int, v: Vector) -> Vector:
        """The vector before a row, given the one behind it."""
        low = min(v)
        key = (code, *(x - low if x < FAR else FAR for x in v))
        held = self.before.get(key)
        if held is None:
            a = [min(c for _, c, _ in self._row(code, s, key[1:])) for s in range(4)]
            u, t = min(a[USER], INSERT + a[ASSISTANT]), min(a[ASSISTANT], INSERT + a[USER])
            held = self.before[key] = tuple(min(x, FAR) for x in (min(a[START], INSERT + u), min(a[SYSTEM], INSERT + u), u, t))
        return tuple(x + low if x < FAR else FAR for x in held)

    def step(self, code: int, v: Vector, state: int) -> tuple[str, str, int]:
        """(states of rows inserted before, edit, next state) of a row in a state, given the vector behind it."""
        low = min(v)
        key = (code, state, *(x - low for x in v))
        held = self.steps.get(key)
        if held is None:
            here, added = self.back(code, key[2:]), ""
            while True:
                edits = self._row(code, state, key[2:])
                if edits[0][1] == here[state]:
                    break
                if INSERT + here[ADDED[state]] == here[state]:
                    state = ADDED[state]
                    added += "ssua"[state]
                    continue
                edits = edits[1:]
                break
            edit, _, after = next(e for e in edits if e[1] == here[state])
            held = self.steps[key] = (added, edit, after)
        return held

    def fold(self, codes: bytes, v: Vector) -> Vector:
        for code in reversed(codes):
            v = self.back(code, v)
        return v

    def matrix(self, codes: bytes) -> list[int]:
        """Costs from each state before the rows to each state behind them."""
        return [c for t in range(4) for c in self.fold(codes, tuple(0 if s == t else FAR for s in range(4)))]

    def walk(self, codes: bytes, right: Vector, state: int) -> Iterator[tuple[str, str, int]]:
        """The steps of the rows, from vectors kept at every square root of them."""
        width = isqrt(len(codes)) + 1
        kept = [right]
        for lo in range((len(codes) - 1) // width * width, 0, -width):
            kept.append(self.fold(codes[lo:lo + width], kept[-1]))
        for lo in range(0, len(codes), width):
            part, vectors = codes[lo:lo + width], [kept.pop()]
            for code in reversed(part[1:]):
                vectors.append(self.back(code, vectors[-1]))
            for code in part:
                held = self.step(code, vectors.pop(), state)
                state = held[2]
                yield held


def tail(state: int) -> str:
    """Initials of the rows inserted behind the last one."""
    return {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}[state]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(df: DataFrame, make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows through a generator of tuples, partition by partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(make(_rows(batches)), arrow), schema)


def _runs(rows: Iterator[tuple], key: Callable[[tuple], object]) -> Iterator[tuple[bool, bool, tuple]]:
    """(first of its run, last of its run, row) of rows that stand by key."""
    last, fresh = None, True
    for row in rows:
        if last is not None:
            ends = key(last) != key(row)
            yield fresh, ends, last
            fresh = ends
        last = row
    if last is not None:
        yield fresh, True, last


def numbered_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, turn, role, text): rows with a number that rises along each conversation; stored.

    Ranges of rows, not of conversations, are dealt out, and equal rows by their place in the input, so no key is hot.
    """
    said = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("place"))
    order = ["conv", "turn", "role", "text", "place"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(said.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place")
                  .select("conv", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text"), "turns")


SPACE = "\x20\x09-\x0D"


def coded(rows: DataFrame) -> DataFrame:
    """(conv, pos, code): a row's initial (0 s, 1 u, 2 a, 3 other) plus four times the number of its fault."""
    firsts = (rows.groupBy("conv", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("h"))
              .agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh")))
    initial = F.substr("role", F.lit(1), F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = rows.select("conv", "pos", kind.alias("kind"), (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
                       F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z").alias("cut"))
    fault = F.when(F.col("blank"), 1).when(F.col("fresh").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    return slim.join(firsts, "pos", "left").select("conv", "pos", (F.col("kind") + 4 * fault).cast("int").alias("code"))


def _segments(codes: DataFrame, kind: str, width: int) -> DataFrame:
    """(conv, at, codes, matrix) of each run of rows of one conversation in one block; its rows are numbered from ``at``."""
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        costs, held = Costs(), bytearray()
        for fresh, ends, (conv, pos, code) in _runs(rows, lambda r: (r[1] // width, r[0])):
            if fresh:
                at, held = pos, bytearray()
            held.append(code)
            if ends:
                yield conv, at, bytes(held), costs.matrix(bytes(held))
    blocks = codes.repartition(F.expr(f"pos div {width}")).sortWithinPartitions("pos")
    return _mapped(blocks, make, f"conv {kind}, at bigint, codes binary, matrix array<bigint>")


def _checkpoints(segments: DataFrame) -> DataFrame:
    """(at, codes, right, final, alone): the vector behind each segment, from the last one of its conversation on."""
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        v = END
        for last, first, (_, at, codes, m) in _runs(rows, lambda r: r[0]):
            v = END if last else v
            yield at, codes, list(v), last, first and last
            v = tuple(min(min(m[4 * t + s] + v[t] for t in range(4)), FAR) for s in range(4))
    ordered = segments.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("at").desc())
    return _mapped(ordered, make, "at bigint, codes binary, right array<bigint>, final boolean, alone boolean")


def _starts(vectors: DataFrame, segments: DataFrame) -> DataFrame:
    """(at, start): the state in which the walk enters each segment of the conversations that have several."""
    def ends(rows: Iterator[tuple]) -> Iterator[tuple]:
        costs = Costs()
        for at, codes, right in rows:
            leads = []
            for state in range(4):
                for *_, state in costs.walk(codes, tuple(right), state):
                    pass
                leads.append(state)
            yield at, leads

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        state = START
        for fresh, _, (_, at, leads) in _runs(rows, lambda r: r[0]):
            state = START if fresh else state
            yield at, state
            state = leads[state]
    led = _mapped(vectors.where("not alone").select("at", "codes", "right").repartition("at"), ends, "at bigint, leads array<int>")
    ordered = segments.select("conv", "at").join(led, "at").select("conv", "at", "leads").repartition("conv").sortWithinPartitions("conv", "at")
    return _mapped(ordered, fold, "at bigint, start int")


def _edits(vectors: DataFrame) -> DataFrame:
    """(pos, code, before, edit, after) of each row; before and after are the initials of inserted rows."""
    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        costs = Costs()
        for at, codes, right, final, start in rows:
            for i, (before, edit, state) in enumerate(costs.walk(codes, tuple(right), start)):
                said = "" if edit == "D" else "user" if state == USER else "assistant" if state == ASSISTANT else "system"
                yield at + i, codes[i], before, edit, said, tail(state) if final and i == len(codes) - 1 else ""
    return _mapped(vectors, make, "pos bigint, code int, before string, edit string, becomes string, after string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", width: int | None = None) -> DataFrame:
    """(conv, pos, turn, role, text, fault, before, edit, new_role, after, cost) of each row, in the order of ``pos``.

    ``before`` and ``after`` hold the initials of rows inserted around a row; ``new_role`` is null where the row goes. ``width``
    is the number of rows of a block (default: the square root of all rows, 4096 at least); it never changes a result.
    """
    rows = numbered_rows(df, conv, turn, role, text)
    kind = rows.schema["conv"].dataType.simpleString()
    width = width or max(LEAST_BLOCK, isqrt(rows.count()))
    segments = stored(_segments(coded(rows), kind, width), "segments")
    vectors = stored(_checkpoints(segments), "checkpoints")
    starts = _starts(vectors, segments)
    edits = _edits(vectors.join(starts, "at", "left").select("at", "codes", "right", "final", F.coalesce("start", F.lit(START)).alias("start")))
    fault = F.shiftright("code", 2)
    cost = (F.when(F.col("edit") == "D", DELETE).otherwise(F.when(fault == 3, TRUNCATED).otherwise(0) + F.when(F.col("edit") == "R", REROLE).otherwise(0))
            + INSERT * (F.length("before") + F.length("after")))
    return rows.join(edits, "pos").select(
        F.col("conv").alias(conv), "pos", F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text),
        F.get(F.array(*[F.lit(f) for f in FAULTS]), fault).alias("fault"), "before", "edit",
        F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") == "R", F.col("becomes")).alias("new_role"), "after", cost.cast("long").alias("cost"))


def repaired_turns(edited: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, nth, role, text): the rows of repaired conversations, inserted ones with empty texts."""
    added = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""),
                                  lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("new_role").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(
        F.array(F.struct(F.col("new_role").alias("role"), F.col(text).alias("text"))))
    out = edited.select(conv, "pos", F.posexplode(F.concat(added("before"), own, added("after"))).alias("nth", "t"))
    return out.select(conv, "pos", "nth", F.col("t.role").alias(role), F.col("t.text").alias(text))


def summaries(edited: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: gaps, counts of faults and of illegal neighbours, cost, audit, repaired_sha256.

    The hash is one chain over all of a conversation's text, so its rows stream through one task in their order; besides the
    audit, which is a value of the result, nothing of them is kept.
    """
    kind = edited.schema[conv].dataType.simpleString()
    names = {"u": "user", "a": "assistant"}

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for fresh, ends, (c, t, initial, body, fault, before, edit, new_role, after, paid) in _runs(rows, lambda r: r[0]):
            if fresh:
                counts, audit, chain, seen, last, low, high, turns, cost = dict.fromkeys(FAULTS, 0), [], hashlib.sha256(), "", None, None, None, 0, 0
                illegal = 0
            else:
                illegal += last + initial not in ("su", "ua", "au")
            if t is not None:
                low, turns, high = t if low is None else low, turns + (t != high), t
            counts[fault] += 1
            cost += paid
            audit.append("I" * len(before) + edit + "I" * len(after))
            lines = [names[x] + ":" for x in before] + ([f"{new_role}:{body}"] if new_role is not None else []) + [names[x] + ":" for x in after]
            for line in lines:
                chain.update((seen + line).encode("utf-8", "surrogatepass"))
                seen = "\n"
            last = initial
            if ends:
                yield (c, 0 if low is None else high - low + 1 - turns, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost,
                       "".join(audit), chain.hexdigest())
    slim = edited.select(conv, turn, F.substr(role, F.lit(1), F.lit(1)).alias("initial"), F.col(text).alias("body"), "fault", "before", "edit", "new_role", "after", "cost", "pos")
    ordered = slim.repartition(conv).sortWithinPartitions(conv, "pos").drop("pos")
    return _mapped(ordered, make, f"`{conv}` {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
                                  "audit string, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """Rows of conversations with faults dealt by crc32 of ``conv_id:turn`` (nulls: one space): a fixed test of the repair."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    said = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                     (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("_lot"))
    lot = F.col("_lot")
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies: Column = F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (said.where("_lot != 0").withColumn("_copy", F.explode(copies))
            .select("conv_id", "turn", F.when(lot == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations")
    found = summaries(repair(damage(told))).withColumnRenamed("conv_id", "_conv")
    every = told.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _twin() -> str:
    """The same rows by a recursion forwards: of each state the cheapest, then ASCII-least, way to it."""
    def more(state: str, cost: str, edit: str, line: str) -> str:
        return f"{{c: {state}.c + {cost}, a: {state}.a || '{edit}', o: {state}.o || {line}}}"

    def added(state: str, role: str) -> str:
        return more(state, f"{INSERT}", "I", f"'{role}:' || chr(10)")

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"
    far = "{c: 1000000000000, a: '', o: ''}"
    gone = "CASE WHEN fault IN (1, 2) THEN 1000000000000 ELSE 0 END + CASE WHEN fault = 3 THEN 3 ELSE 0 END"
    dropped = [more(f"e{s}", f"{DELETE}", "D", "''") for s in range(4)]

    def kept(state: str, initial: str) -> str:
        return more(state, f"{gone} + CASE WHEN c = '{initial}' THEN 0 ELSE 1000000000000 END", "K", "role || ':' || text || chr(10)")

    def named(state: str, role: str) -> str:
        return more(state, f"{gone} + {REROLE}", "R", f"'{role}:' || text || chr(10)")
    froms = ("e0", "e1", "e3")
    ws = r"\x20\x09-\x0D"
    crc = ("list_reduce([4294967295::UBIGINT] || list_transform(string_split(key, ''), lambda x: ord(x)::UBIGINT), lambda a, b: list_reduce([xor(a, b)] || "
           "[0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda m, z: xor(m >> 1, (m & 1) * 3988292384::UBIGINT)))")
    return f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT *, xor({crc}, 4294967295::UBIGINT) % 20 AS lot FROM r),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) FROM k WHERE lot <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^{ws}]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][{ws}]*$') THEN 3 ELSE 0 END AS fault FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
  count_if(fault = 3) AS truncated, count_if(before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM f GROUP BY conv_id),
t AS (SELECT conv_id, 0::BIGINT AS i, {{c: 0::BIGINT, a: '', o: ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM g
  UNION ALL SELECT conv_id, i, {dropped[0]}, {least(dropped[1], kept('e0', 's'))},
    {least(dropped[2], *[kept(s, 'u') for s in froms], *[named(s, 'user') for s in froms])}, {least(dropped[3], kept('e2', 'a'), named('e2', 'assistant'))}
  FROM (SELECT *, {least('s3', added('e2', 'assistant'))} AS e3 FROM (SELECT t.conv_id, f.i, f.role, f.text, f.c, f.fault, s0 AS e0, s1 AS e1, s3,
    {least('s2', added('s0', 'user'), added('s1', 'user'), added('s3', 'user'))} AS e2 FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i + 1))),
z AS (SELECT t.conv_id, gaps, blank, duplicate, truncated, illegal, {least('s0', 's3', added('s2', 'assistant'), added(f"({added('s1', 'user')})", 'assistant'))} AS b
  FROM t JOIN g ON g.conv_id IS NOT DISTINCT FROM t.conv_id AND g.rows = t.i)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(left(b.o, greatest(length(b.o) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _twin()
