"""Text columns: unescape, collapse, truncate, keys, title case, abbreviations, cleaning."""
from __future__ import annotations

import html.entities
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules

SPACE = r"(?U)\s+"
#: the named table of the HTML standard, as the standard library has it; names of old may stand without ";"
ENTITIES = html.entities.html5
OLD_NAMES = sorted((n for n in ENTITIES if not n.endswith(";")), key=lambda n: (-len(n), n))
#: numbers 128 to 159 are read as Windows-1252; its five gaps stand for themselves
WINDOWS = {n: chr(n) if n in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([n]).decode("cp1252") for n in range(0x80, 0xA0)}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Bind a value once and use it many times; keeps large expressions small."""
    return F.get(F.transform(F.array(value), body), 0)


def alternation(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def _any_inside(text: Column, words: list[str]) -> Column:
    """Plain substring tests are several times cheaper than one pattern."""
    test = text.contains(words[0])
    for w in words[1:]:
        test = test | text.contains(w)
    return test


def inside(text: Column, words: list[str]) -> Column:
    """``contains_any`` for a text that is already a plain column or a bound value."""
    test = _any_inside(text, words) if len(words) <= 40 else text.rlike(alternation(words))
    return F.coalesce(test, F.lit(False))


def contains_any(text: Column | str, words: list[str]) -> Column:
    """Any of the words occurs as a substring (case as given); null text -> false."""
    return inside(col(text), words) if isinstance(text, str) else let(text, lambda t: inside(t, words))


def word_inside(text: Column, words: list[str]) -> Column:
    """``has_word`` for a plain column or a bound value.

    Texts without the letters of any phrase are settled by substring tests; the pattern starts with the
    possible first letters, so that the boundary is examined only there.
    """
    first = "".join(sorted({re.escape(w[0]) for w in words}))
    pattern = rf"(?=[{first}])(?U)\b{alternation(words)}\b"
    return inside(text, words) & F.coalesce(text.rlike(pattern), F.lit(False))


def has_word(text: Column | str, words: list[str]) -> Column:
    """Any of the phrases occurs between word boundaries."""
    return word_inside(col(text), words) if isinstance(text, str) else let(text, lambda t: word_inside(t, words))


def blank_to_null(x: Column | str) -> Column:
    trimmed = F.trim(col(x))
    return F.when(trimmed != "", trimmed)


def first_filled(*cols: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def collapse_spaces(x: Column | str) -> Column:
    return F.regexp_replace(col(x), SPACE, " ")


def _numbered(number: Column) -> Column:
    """The character of a code point; null stands for a number too large to hold. Bad ones give U+FFFD or nothing."""
    def char(n: Column) -> Column:
        windows = F.element_at(F.from_json(F.lit(json.dumps(WINDOWS)), "map<string,string>"), n.cast("string"))
        nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 0xFFFE)
        bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return (F.when(bad, F.lit("\ufffd")).when(n.between(128, 159) & windows.isNotNull(), windows).when(nothing, "")
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
    return let(F.coalesce(number, F.lit(0x110000)), char)


#: the references that nearly all texts use, with what they stand for (fixed values)
COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\u00a0", "#39;": "'"}


def _reference(part: Column) -> Column:
    """What follows an ampersand, decoded; text that is no reference gets its ampersand back."""
    dec, hexed = F.regexp_extract(part, "^#([0-9]+);?", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+);?", 1)
    name = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
    old = F.regexp_extract(part, "^(?:" + "|".join(OLD_NAMES) + ")", 0)
    table = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    known = F.coalesce(F.element_at(table, F.when(name != "", name)), F.lit(""))
    chain = F.when(~part.rlike("^[#A-Za-z]"), F.concat(F.lit("&"), part))
    for word, value in COMMON.items():  # tested first, without a pattern or a look at the table
        chain = chain.when(part.startswith(word), F.concat(F.lit(value), F.substr(part, F.lit(len(word) + 1))))
    return (chain.when(dec != "", F.concat(_numbered(dec.try_cast("bigint")), F.regexp_replace(part, "^#[0-9]+;?", "")))
            .when(hexed != "", F.concat(_numbered(F.conv(F.when(F.length(F.ltrim(hexed, F.lit("0"))) <= 8, hexed), 16, 10).try_cast("bigint")),
                                        F.regexp_replace(part, "^#[xX][0-9a-fA-F]+;?", "")))
            .when(known != "", F.concat(known, F.substr(part, F.length(name) + 1)))
            .when(old != "", F.concat(F.element_at(table, F.when(old != "", old)), F.substr(part, F.length(old) + 1)))
            .otherwise(F.concat(F.lit("&"), part)))


def unescape(x: Column | str, closed: bool = False) -> Column:
    """Every HTML character reference, named (the full table) and numeric, without Python; no input makes it fail.

    The standard also reads some names and all numbers without their ``;``; with ``closed`` only references that have it are read.
    """
    def one(part: Column) -> Column:
        if not closed:
            return _reference(part)
        whole = F.regexp_extract(part, r"^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 0)
        known = F.when(whole.startswith("#"), True).otherwise(F.element_at(F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>"), F.when(whole != "", whole)).isNotNull())
        return F.when(known, _reference(part)).otherwise(F.concat(F.lit("&"), part))

    def decoded(v: Column) -> Column:
        parts = F.split(v, "&")
        return F.when(v.contains("&"), F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")).otherwise(v)
    return let(col(x), decoded)


def normalize_text(x: Column | str) -> Column:
    return collapse_spaces(unescape(strip(x)))


def norm_tag(x: Column | str) -> Column:
    return F.lower(normalize_text(x))


def safe_truncate(x: Column | str, limit: int) -> Column:
    value = col(x)
    head = F.regexp_replace(F.substring(value, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(F.regexp_replace(head, r"(?U)\s+$", ""), F.lit("…")))


def truncate_dots(x: Column | str, limit: int) -> Column:
    """Cut at the last space within the limit and add three dots."""
    value = col(x)
    head = F.regexp_replace(F.substring(value, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(head, F.lit("...")))


def unique_list(values: Column | str) -> Column:
    """Normalised, non-empty, unique in order of first appearance; null -> empty list."""
    cleaned = F.filter(F.transform(col(values), norm_tag), lambda v: v != "")
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def scalar_or_list(value: Column | str) -> Column:
    """A single string is a list of one."""
    return unique_list(F.when(col(value).isNotNull(), F.array(col(value))))


def loose_bool(x: Column | str) -> Column:
    """Words and numbers to boolean: known words first, any other number by non-zero, other text true."""
    s = F.lower(F.trim(col(x).cast("string")))
    number = s.try_cast("double")
    return (F.when(s.isNull() | s.isin("false", "0", "no", "off", "none", ""), False)
            .when(s.isin("true", "1", "yes", "on"), True)
            .when(number.isNotNull(), number != 0)
            .otherwise(True))


def loose_bool_map(attrs: Column | str) -> Column:
    return F.transform_values(col(attrs), lambda k, v: loose_bool(v))


def parse_number(x: Column | str) -> Column:
    return F.replace(col(x).cast("string"), F.lit(","), F.lit(".")).try_cast("double")


def long_description(x: Column | str, limit: int = rules.MAX_EVENT_DESCRIPTION) -> tuple[Column, Column]:
    """(shown description, full text only when it was cut)."""
    value = col(x)
    short = safe_truncate(value, limit)
    return short, F.when(short != value, value)


# ---- names ---------------------------------------------------------------------------------

def match_name(x: Column | str) -> Column:
    """Comparison form of a name: lower, each prefix then each suffix removed once in list order."""
    value = F.lower(F.coalesce(col(x), F.lit("")))
    for word in rules.NAME_PREFIXES:
        value = F.regexp_replace(value, f"^{word} ", "")
    for word in rules.NAME_SUFFIXES:
        value = F.regexp_replace(value, f" {word}$", "")
    return strip(collapse_spaces(value))


def match_address(x: Column | str) -> Column:
    value = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))),
                             r"(?U)\b" + alternation(rules.ADDRESS_NOISE) + r"\b", "")
    return strip(collapse_spaces(F.regexp_replace(value, r"(?U)[^\w\s]", " ")))


def valid_name(x: Column | str) -> tuple[Column, Column]:
    """(cleaned name, whether its length is 2..200)."""
    cleaned = collapse_spaces(F.regexp_replace(F.trim(col(x)), r"^[-–—•]\s*", ""))
    return cleaned, F.coalesce(F.length(cleaned).between(2, 200), F.lit(False))


def title_case(x: Column | str) -> Column:
    words = F.split(strip(x), SPACE)
    cased = F.transform(words, lambda w, i: F.when(
        (i > 0) & F.lower(w).isin(rules.SMALL_WORDS), F.lower(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))))
    return F.array_join(cased, " ")


def expand_abbreviations(x: Column | str, table: dict[str, str] | None = None, city: bool = False,
                         exact_old: bool = False) -> Column:
    """Whole-word abbreviations, with or without the final dot, in table order.

    ``exact_old`` keeps the narrower form in which a dotted key matches only before another word character.
    """
    table = dict(table or rules.ABBREVIATIONS)
    if city:
        table.update(rules.CITY_ABBREVIATIONS)
    value = col(x)
    for short, full in table.items():
        pattern = rf"(?i)\b{re.escape(short)}\.\b" if exact_old else rf"(?i)\b{re.escape(short)}\b\.?"
        value = F.regexp_replace(value, pattern, full)
    return value


def strip_tags(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"<[^>]+>", "")


def single_tag(x: Column | str, joiner: str = "-") -> Column:
    base = F.lower(strip(collapse_spaces(strip_tags(x))))
    cleaned = F.replace(F.regexp_replace(base, r"(?U)[^\w\s\-]", ""), F.lit(" "), F.lit(joiner))
    return F.when(cleaned != "", cleaned)


def tag_list(values: Column | str, joiner: str = "-") -> Column:
    return F.array_distinct(F.filter(F.transform(col(values), lambda t: single_tag(t, joiner)),
                                     lambda t: t.isNotNull()))


def remove_patterns(x: Column | str, patterns: list[str]) -> Column:
    value = col(x)
    for pattern in patterns:
        value = F.regexp_replace(value, "(?i)" + pattern, "")
    return F.trim(collapse_spaces(value))


def recipe_clean(x: Column | str, drop_special: bool = False) -> Column:
    value = collapse_spaces(strip_tags(F.coalesce(col(x), F.lit(""))))
    if drop_special:
        value = F.regexp_replace(value, r"(?U)[^\w\s\-.,!?]", "")
    return F.trim(value)


def trim_bullets(x: Column | str) -> Column:
    value = col(x)
    for b in rules.BULLETS_FRONT:
        value = F.regexp_replace(value, rf"^{re.escape(b)}\s*", "")
    for b in rules.BULLETS_BACK:
        value = F.regexp_replace(value, rf"\s*{re.escape(b)}$", "")
    return F.trim(value)


def area_title(x: Column | str) -> Column:
    """Known areas in their listed spelling, other text in title case."""
    low = F.lower(F.trim(col(x)))
    known = F.create_map(*[F.lit(v) for a in rules.AREA_TITLES for v in (a.lower(), a)])
    return F.when(F.coalesce(col(x), F.lit("")) == "", F.lit("")).otherwise(
        F.coalesce(F.try_element_at(known, low), F.initcap(col(x))))


def cut_with_dots(x: Column | str, limit: int) -> Column:
    return F.when(F.length(col(x)) > limit, F.concat(F.substring(col(x), 1, limit - 3), F.lit("..."))).otherwise(col(x))


# ---- tokens --------------------------------------------------------------------------------

def tokens_en(x: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(x)), "[^a-z0-9]+"), lambda t: t != ""))


def stem_en(w: Column | str) -> Column:
    word = col(w)
    n = F.length(word)
    return (F.when((n > 3) & word.endswith("ies"), F.concat(F.substr(word, F.lit(1), n - 3), F.lit("y")))
            .when((n > 2) & word.endswith("es"), F.substr(word, F.lit(1), n - 2))
            .when((n > 1) & word.endswith("s") & ~word.endswith("ss"), F.substr(word, F.lit(1), n - 1))
            .otherwise(word))


def word_set(x: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(x)), SPACE), lambda t: t != ""))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard of two word arrays; 0 when either is empty."""
    union = F.size(F.array_union(col(a), col(b)))
    both = F.size(F.array_intersect(col(a), col(b)))
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), both / union).otherwise(F.lit(0.0))


def levenshtein_ratio(a: Column | str, b: Column | str) -> Column:
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest > 0, 1 - F.levenshtein(col(a), col(b)) / longest).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; for candidate pairs only, never for a raw product."""
    from difflib import SequenceMatcher
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)],
                     dtype="float64")


def search_text(*parts: Column | str, tags: Column | str | None = None) -> Column:
    pieces = [F.when(F.coalesce(col(p), F.lit("")) != "", col(p)) for p in parts]
    if tags is not None:
        pieces.append(F.when(F.size(col(tags)) > 0, F.array_join(col(tags), " ")))
    return F.concat_ws(" ", *pieces)
