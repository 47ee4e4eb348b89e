"""SQL text for the twins, written from the stated rules."""
from __future__ import annotations

import re

from .. import rules


WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(e: str) -> str:
    return f"regexp_replace({e}, '{WS}+', ' ', 'g')"


#: the references that occur in the tables, with their characters; ``&amp;`` last
ENTITIES_USED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "\u00a9", "&reg;": "\u00ae", "&middot;": "\u00b7",
                 "&ndash;": "\u2013", "&mdash;": "\u2014", "&hellip;": "\u2026", "&eacute;": "\u00e9", "&amp;": "&"}


def unescape(e: str) -> str:
    for entity, char in ENTITIES_USED.items():
        e = f"replace({e}, {q(entity)}, {q(char)})"
    return e


def norm(e: str) -> str:
    return collapse(unescape(strip(e)))


def alt(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in words) + ")"


def has(e: str, words: list[str]) -> str:
    return f"coalesce(regexp_matches({e}, {q(alt(words))}), false)"


def has_word(e: str, words: list[str]) -> str:
    return f"coalesce(regexp_matches({e}, {q(r'\b' + alt(words) + r'\b')}), false)"


def strs(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def join(e: str) -> str:
    return f"array_to_string({e}, '|')"


def match_name(e: str) -> str:
    e = f"lower(coalesce({e}, ''))"
    for w in rules.NAME_PREFIXES:
        e = f"regexp_replace({e}, '^{w} ', '')"
    for w in rules.NAME_SUFFIXES:
        e = f"regexp_replace({e}, ' {w}$', '')"
    return strip(collapse(e))


def match_address(e: str) -> str:
    e = f"regexp_replace(lower(coalesce({e}, '')), {q(r'\b' + alt(rules.ADDRESS_NOISE) + r'\b')}, '', 'g')"
    return strip(collapse(f"regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"))


def fixed3(e: str) -> str:
    return f"printf('%.3f', round_even({e}, 3))"


def match_key(name="name", city="city", domain="domain", lat="geo_lat", lng="geo_lng") -> str:
    geo = f"{lat} is not null and {lng} is not null"
    return (f"md5(concat_ws('|', nullif({match_name(name)}, ''), nullif(lower({city}), ''), nullif(lower({domain}), ''), "
            f"case when {geo} then {fixed3(lat)} end, case when {geo} then {fixed3(lng)} end))")


def keyword_flags(text: str) -> str:
    parts = ", ".join(f"case when {has_word(text, words)} then {q(flag)} end" for flag, words in sorted(rules.FLAG_KEYWORDS.items()))
    return f"list_filter([{parts}], lambda x: x is not null)"


def attrs(text: str) -> dict[str, str]:
    return {name: has(text, words) for name, words in rules.ATTRIBUTE_WORDS.items()}


def lev_ratio(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"


def ladder(e: str, table, value=q, default: str = "null") -> str:
    whens = " ".join(f"when {has(e, words)} then {value(v)}" for v, words in table)
    return f"case {whens} else {default} end"


def first_value(e: str, table: dict, other, missing) -> str:
    whens = " ".join(f"when contains(lower({e}), {q(k)}) then {v}" for k, v in table.items())
    return f"case when coalesce({e}, '') = '' then {missing} {whens} else {other} end"


def cascade(e: str, table, default: str) -> str:
    whens = " ".join(f"when regexp_matches(lower(coalesce({e}, '')), {q('|'.join(words))}) then {q('|'.join(flags))}" for words, flags in table)
    return f"case {whens} else {default} end"
