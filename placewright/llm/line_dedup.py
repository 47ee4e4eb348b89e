"""Line dedup by a segment-partition edit join, in built-in columns only.

A line of at least ``min_chars`` characters is a copy if an equal line, or one within ``errors`` edits, stands earlier in the
corpus (by id, then line number). Copies are removed, the earliest stays; shorter lines carry no evidence and stay.

Equal lines become one row first: a 96-bit name and the line's keys, never its text. Lengths fall into classes, and the class,
not the length, gives the size of the ``errors + 1`` segments; the first segments stand at the line's start, the last ones at its end, what
is left over lies between. Of two lines within the distance one has a segment with ``i`` edits before it and at most
``errors - i`` behind, so the other has it moved by at most the smaller of the two. A line offers its own segments and asks for
the moved ones, and for those of the class below if a shorter line could belong there: five keys of 64 bits for two
errors, ten near the lower end of a class. All keys are shuffled once, and only those that two lines share go on; there is no
filter that fills up as the table grows.

The lines of shared keys are few. Their texts are read, and the counts of sixteen frequent characters, whose distance
is part of the join condition: lines that differ in a whole word rarely come out as candidates, so a template with many
fillings does not give all its pairs. The candidates are compared by a banded bit-parallel edit distance, exact, in one
``aggregate`` over the longer line's characters.

Null ids order first. Null and empty texts have no line. Rows that repeat id and text count as one document, and each
gets the same result. Columns other than id and text are ignored. A hot line is combined before the shuffle. Lines removed
from a document are gathered as numbers, bounded by its lines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

ERRORS, MIN_CHARS = 2, 40
#: frequent characters whose counts are compared; any choice is right, frequent ones tell more
COUNTED = ("etnhaior", "sldcumgp")
#: words of the bitmap of segment keys, 64 bits each: its size does not grow with the table
BITMAP_WORDS = 1 << 19


def lines_of(docs: DataFrame, ident: str, text: str, min_chars: int) -> DataFrame:
    """(id, at, line) of every line that is long enough."""
    each = docs.select(F.col(ident).alias("id"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return each.where(F.length("line") >= min_chars)


def _names(line: str = "line") -> list[Column]:
    """A 96-bit name of a line, so that texts need not travel."""
    return [F.xxhash64(line).alias("h"), F.crc32(F.col(line).cast("binary")).alias("c")]


def _base(length: Column) -> Column:
    """The smallest length of the class that a length falls into."""
    return (length - length % F.when(length < 128, 8).otherwise(32)).cast("int")


def keys_of(line: str, errors: int) -> Column:
    """The line's own ``errors + 1`` keys, then those under which a line of the same or a smaller length within ``errors`` may stand; null
    where the class below need not be asked. No class is narrower than eight lengths, so there is one at most."""
    if errors > 8:
        raise ValueError("classes of lengths are too narrow for more than eight errors")
    n = F.length(line)

    def key(base: Column, i: int, shift: int) -> Column:
        size = F.floor(base / (errors + 1)).cast("int")
        start = size * i if i <= errors - i else n - size * (errors + 1 - i)
        return F.xxhash64(base, F.lit(i), F.substr(line, start + shift + 1, size))
    reach = [min(i, errors - i) for i in range(errors + 1)]
    places = [(i, 0) for i in range(errors + 1)] + [(i, shift) for i, r in enumerate(reach) for shift in range(-r, r + 1) if shift]
    here, below = _base(n), _base(n - errors)
    return F.array(*[key(here, i, shift) for i, shift in places], *[F.when(below != here, key(below, i, shift)) for i, shift in places])


def char_counts(line: str, chars: str) -> Column:
    """Eight counts modulo 256 in one number."""
    out = F.lit(0).cast("bigint")
    for k, char in enumerate(chars):
        n = (F.length(line) - F.length(F.replace(line, F.lit(char), F.lit("")))) % 256
        out = out.bitwiseOR(F.shiftleft(n.cast("bigint"), 8 * k))
    return out


def counts_fit(a: list[Column], b: list[Column], errors: int) -> Column:
    """An edit changes at most two of the counts by one."""
    total = F.lit(0)
    for x, y in zip(a, b):
        for k in range(8):
            d = F.abs(F.shiftrightunsigned(x, 8 * k).bitwiseAND(255) - F.shiftrightunsigned(y, 8 * k).bitwiseAND(255))
            total = total + F.least(d, 256 - d)
    return total <= 2 * errors


def within_edits(a: Column, b: Column, errors: int) -> Column:
    """Whether two array columns of characters lie within ``errors`` edits, by bit vectors over the band of the table.

    Bit k of a vector stands for the row ``j - errors + k`` of column j. The distance is followed down the band's lowest
    diagonal until that leaves the table, then along the last row.
    """
    m, width = F.size(a), 2 * errors + 1
    full = (1 << width) - 1

    def step(s: Column, j: Column) -> Column:
        same = F.lit(0)
        for k in range(width):
            i = j - errors + k
            hit = (i >= 1) & (i <= m) & F.coalesce(F.get(a, i - 1) == F.get(b, j - 1), F.lit(False))
            same = same.bitwiseOR(F.when(hit, 1 << k).otherwise(0))
        # each intermediate is bound by a one-element transform, so that it is evaluated once
        first = F.struct(same.alias("x"), s.vp.alias("vp"), s.vn.alias("vn"), s.d.alias("d"))
        second = F.transform(F.array(first), lambda f: F.struct(
            (f.x.bitwiseAND(f.vp) + f.vp).bitwiseXOR(f.vp).bitwiseOR(f.x).bitwiseOR(f.vn).bitwiseAND(full).alias("d0"),
            f.vp.alias("vp"), f.vn.alias("vn"), f.d.alias("d")))
        third = F.transform(second, lambda f: F.struct(
            f.d0.alias("d0"), f.vn.bitwiseOR(f.d0.bitwiseOR(f.vp).bitwiseXOR(full)).alias("hp"), f.d0.bitwiseAND(f.vp).alias("hn"), f.d.alias("d")))
        row = m - j + errors  # the last row's bit once the diagonal has left the table
        at = F.pow(F.lit(2), F.greatest(row, F.lit(0))).cast("int")
        last = F.transform(third, lambda f: F.struct(
            f.hn.bitwiseOR(F.shiftright(f.d0, 1).bitwiseOR(f.hp).bitwiseXOR(full)).alias("vp"),
            F.shiftright(f.d0, 1).bitwiseAND(f.hp).alias("vn"),
            (f.d + F.when(j + errors <= m, F.when(f.d0.bitwiseAND(1 << (width - 1)) == 0, 1).otherwise(0)).otherwise(
                F.when(f.hp.bitwiseAND(at) != 0, 1).otherwise(0) - F.when(f.hn.bitwiseAND(at) != 0, 1).otherwise(0))).alias("d")))
        return F.get(last, 0)

    start = F.struct(F.lit(full ^ ((1 << errors) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(errors).alias("d"))
    end = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step, lambda s: s.d)
    return (F.abs(F.size(a) - F.size(b)) <= errors) & (end <= errors)


def in_bitmap(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """The probes whose key may be among the keys: a broadcast of at most BITMAP_WORDS rows spares the rest the shuffle."""
    word = lambda k: F.col(k).bitwiseAND(BITMAP_WORDS - 1)
    bits = keys.select(word("key").alias("_word"), F.expr("shiftleft(1L, int(shiftrightunsigned(key, 58)))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = probes.withColumn("_word", word("key")).join(F.broadcast(bits), "_word")
    return held.where("(_bits & shiftleft(1L, int(shiftrightunsigned(key, 58)))) != 0").drop("_word", "_bits")


def shared_keys(docs: DataFrame, ident: str = "doc_id", text: str = "text", errors: int = ERRORS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, h, c, own): the keys that a line shares with another, and whether they are its own segments."""
    once = lines_of(docs, ident, text, min_chars).select(*_names(), keys_of("line", errors).alias("keys")).distinct()
    keys = once.select("h", "c", F.posexplode("keys").alias("at", "key"))
    # the mark stands above the 32 bits of the checksum: both sides of the join are one shuffle
    keys = keys.where("key is not null").select("key", "h", F.col("c").bitwiseOR(F.when(F.col("at") <= errors, 1 << 32).otherwise(0)).alias("c"))
    name = lambda side: F.col(f"{side}.c").bitwiseAND((1 << 32) - 1)
    other = (F.col("x.key") == F.col("y.key")) & ((F.col("x.h") != F.col("y.h")) | (name("x") != name("y")))
    met = keys.alias("x").join(keys.alias("y"), other, "left_semi")
    return met.select("key", "h", name("x").alias("c"), (F.col("c") >= 1 << 32).alias("own"))


def close_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", errors: int = ERRORS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, c) of the lines that have a different line within the distance before them."""
    shared = stored(shared_keys(docs, ident, text, errors, min_chars), "line-keys")
    names = shared.select("h", "c").distinct()
    lines = in_bitmap(lines_of(docs, ident, text, min_chars).select(*_names(), "id", "at", "line").withColumn("key", F.col("h")), names.select(F.col("h").alias("key")))
    # an inner join: the optimizer would move a semi join before the bitmap, and shuffle every text
    known = lines.join(names, ["h", "c"]).groupBy("h", "c").agg(F.min(F.struct("id", "at")).alias("first"), F.min("line").alias("line"))
    known = stored(known.select("*", *[char_counts("line", x).alias(f"counts{i}") for i, x in enumerate(COUNTED)]), "lines")
    asked = shared.join(known.drop("line"), ["h", "c"])
    one, two = [asked.select("key", *[F.col(x).alias(f"{x}_{side}") for x in ("h", "c", "own", "first", "counts0", "counts1")]) for side in "ab"]
    name = lambda side: F.struct(F.col(f"h_{side}").alias("h"), F.col(f"c_{side}").alias("c"))
    fits = (one["key"] == two["key"]) & (name("a") < name("b")) & (F.col("own_a") | F.col("own_b")) & counts_fit(
        [F.col("counts0_a"), F.col("counts1_a")], [F.col("counts0_b"), F.col("counts1_b")], errors)
    earlier = F.col("first_a") < F.col("first_b")
    pairs = stored(one.join(two, fits).select(F.when(earlier, name("a")).otherwise(name("b")).alias("early"),
                                              F.when(earlier, name("b")).otherwise(name("a")).alias("late")).distinct(), "line-pairs")
    texts = known.select(F.struct("h", "c").alias("name"), F.split("line", "").alias("chars"))
    both = (pairs.join(texts.select(F.col("name").alias("early"), F.col("chars").alias("x")), "early")
            .join(texts.select(F.col("name").alias("late"), F.col("chars").alias("y")), "late"))
    longer = F.size("x") >= F.size("y")
    close = both.where(within_edits(F.when(longer, F.col("y")).otherwise(F.col("x")), F.when(longer, F.col("x")).otherwise(F.col("y")), errors))
    return close.select("late.*").distinct()


def copied_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", errors: int = ERRORS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, c, first, removed): of each distinct long line its earliest place, and whether an earlier line is within the distance."""
    gone = close_lines(docs, ident, text, errors, min_chars).withColumn("removed", F.lit(True))
    place = lines_of(docs, ident, text, min_chars).select("id", "at", *_names()).groupBy("h", "c").agg(F.min(F.struct("id", "at")).alias("first"))
    return place.join(gone, ["h", "c"], "left").select("h", "c", "first", F.coalesce("removed", F.lit(False)).alias("removed"))


def removed_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", errors: int = ERRORS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, lines): the numbers of the lines to remove, for documents that lose any."""
    known = copied_lines(docs, ident, text, errors, min_chars)
    places = lines_of(docs, ident, text, min_chars).select("id", "at", *_names())
    lost = places.join(known, ["h", "c"]).where("removed or not (first.id <=> id and first.at = at)")
    return lost.groupBy("id").agg(F.array_sort(F.collect_set("at")).alias("lines"))


def dedup_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", errors: int = ERRORS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows with copied lines removed from the text; all other columns as they were."""
    lost = removed_lines(docs, ident, text, errors, min_chars).select(F.col("id").alias("_lost_id"), F.col("lines").alias("_lost_lines"))
    joined = docs.join(lost, docs[ident].eqNullSafe(lost["_lost_id"]), "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("_lost_lines", i))
    return joined.withColumn(text, F.when(F.col("_lost_lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many are removed, their numbers from 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = removed_lines(docs)
    lines = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    joined = lines.join(lost, lines["doc_id"].eqNullSafe(lost["id"]), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce(F.array_join(F.transform("lines", lambda i: i.cast("string")), ","), F.lit("")).alias("removed_lines"))


SQL = f"""
WITH ln AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
d AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM ln WHERE length(line) >= {MIN_CHARS} GROUP BY line),
p AS (SELECT DISTINCT CASE WHEN a.first < b.first THEN b.line ELSE a.line END AS line FROM d a JOIN d b
  ON b.n BETWEEN a.n AND a.n + {ERRORS} AND a.line <> b.line WHERE levenshtein(a.line, b.line) <= {ERRORS}),
g AS (SELECT doc_id, pos FROM ln JOIN d USING (line) LEFT JOIN p USING (line) WHERE p.line IS NOT NULL OR d.first <> (doc_id, pos)),
s AS (SELECT doc_id, count(*) AS n_removed, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(removed, '') AS removed_lines FROM documents LEFT JOIN s USING (doc_id)
"""
