"""Flags, attributes and tag matching as columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import alternation, col, contains_any, inside, let, norm_tag, stem_en, tokens_en, word_inside



def _empty() -> Column:
    return F.array().cast("array<string>")


def _words(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def content_text(title, description, tags) -> Column:
    """Lower title and description plus tags; nulls count as empty."""
    return F.concat_ws(" ", F.lower(F.coalesce(col(title), F.lit(""))),
                       F.lower(F.coalesce(col(description), F.lit(""))),
                       F.array_join(F.coalesce(col(tags), _empty()), " "))


def keyword_flags(title, description, tags, table: dict[str, list[str]] = rules.FLAG_KEYWORDS) -> Column:
    """Sorted flags whose keywords occur as whole words."""
    return let(content_text(title, description, tags), lambda text: F.array_sort(F.array_compact(F.array(
        *[F.when(word_inside(text, words), F.lit(flag)) for flag, words in table.items()]))))


def place_keyword_flags(name, description, tags, existing) -> Column:
    """Flags already on the place win; keywords only fill an empty list."""
    return F.when(F.size(F.coalesce(col(existing), _empty())) > 0, F.array_sort(F.array_distinct(col(existing)))) \
        .otherwise(keyword_flags(name, description, tags))


def cascade_flags(text, cascade=rules.FLAG_CASCADE_TEXT, default: Column | None = None) -> Column:
    """Flags of the first branch with a matching substring."""
    def branches(low: Column) -> Column:
        chain = F.when(F.lit(False), _empty())
        for words, flags in cascade:
            chain = chain.when(inside(low, words), _words(flags))
        return chain.otherwise(default if default is not None else _words(rules.CASCADE_DEFAULT))
    return let(F.lower(F.coalesce(col(text), F.lit(""))), branches)


def cascade_flags_content(title, description) -> Column:
    return cascade_flags(F.concat_ws(" ", col(title), col(description)), rules.FLAG_CASCADE_CONTENT)


def cascade_flags_url(url, category) -> Column:
    chain = F.when(F.lit(False), _empty())
    for names, flags in rules.CATEGORY_DEFAULT_FLAGS:
        chain = chain.when(col(category).isin(names), _words(flags))
    return cascade_flags(url, rules.FLAG_CASCADE_URL, chain.otherwise(_words(rules.CASCADE_DEFAULT)))


def substring_flags(title, tags) -> Column:
    """All flags with a matching substring, sorted."""
    text = F.lower(F.concat_ws(" ", col(title), F.array_join(F.coalesce(col(tags), _empty()), " ")))
    return let(text, lambda t: F.array_sort(F.array_compact(F.array(
        *[F.when(inside(t, words), F.lit(flag)) for flag, words in rules.FLAGS_FROM_SUBSTRINGS.items()]))))


def text_attributes(title, description) -> Column:
    """Map of the eight boolean attributes; substring tests, as in ``art`` inside ``party``."""
    text = F.lower(F.concat_ws(" ", col(title), F.coalesce(col(description), F.lit(""))))
    return let(text, lambda t: F.create_map(
        *[c for name, words in rules.ATTRIBUTE_WORDS.items() for c in (F.lit(name), inside(t, words))]))


def true_keys(attrs) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(col(attrs), lambda k, v: v)))


def enriched_tags(tags, labels) -> Column:
    """Lower, trimmed, unique tags followed by the codes of known editor labels."""
    def tidy(values):
        return F.filter(F.transform(F.coalesce(col(values), _empty()), lambda t: F.lower(F.trim(t))),
                        lambda t: F.coalesce(t != "", F.lit(False)))
    table = F.create_map(*[F.lit(v) for pair in rules.EDITOR_LABELS.items() for v in pair])
    codes = F.filter(F.transform(tidy(labels), lambda t: F.try_element_at(table, t)), lambda t: t.isNotNull())
    return F.array_distinct(F.concat(tidy(tags), codes))


def flags_from_tags(tags, attrs) -> Column:
    """Flags that tags imply when the attribute map does not carry them, sorted."""
    low = F.transform(F.coalesce(col(tags), _empty()), lambda t: F.lower(t))
    return F.array_sort(F.array_compact(F.array(*[
        F.when(F.arrays_overlap(low, F.array(*[F.lit(t) for t in words]))
               & ~F.coalesce(F.try_element_at(col(attrs), F.lit(flag)), F.lit(False)), F.lit(flag))
        for flag, words in rules.FLAGS_FROM_TAGS.items()])))


# ---- matching a query word against tags -----------------------------------------------------

def tag_phrases(tags, attrs=None) -> Column:
    phrases = F.filter(F.transform(F.coalesce(col(tags), _empty()), norm_tag), lambda t: t != "")
    if attrs is not None:
        extra = F.array_compact(F.flatten(F.array(*[
            F.when(F.coalesce(F.try_element_at(col(attrs), F.lit(a)), F.lit(False)),
                   F.array(*[F.lit(p) for p in names])).otherwise(_empty())
            for a, names in rules.ATTRIBUTE_PHRASES.items()])))
        phrases = F.concat(phrases, extra)
    return F.array_distinct(phrases)


def tag_tokens(tags) -> Column:
    phrases = F.transform(F.coalesce(col(tags), _empty()), norm_tag)
    return F.array_distinct(F.flatten(F.transform(phrases, tokens_en)))


def _aliases(query: Column) -> Column:
    base = stem_en(query)
    table = F.create_map(*[c for key, values in rules.TAG_ALIASES.items()
                           for c in (F.lit(key), F.array(*[F.lit(v) for v in values]))])
    return F.coalesce(F.try_element_at(table, base), F.array_distinct(F.array(query, base)))


def tag_match_score(query, tags, attrs=None) -> Column:
    """2 exact phrase or alias, 1 shared token or stem (own or of an alias), else 0."""
    def score(p: Column) -> Column:
        q, phrases, tokens = p["q"], p["phrases"], p["tokens"]
        stems = F.transform(tokens, stem_en)
        q_tokens = tokens_en(q)
        q_stems = F.when(F.size(q_tokens) > 0, F.transform(q_tokens, stem_en)).otherwise(F.array(stem_en(q)))

        def by_alias(aliases: Column) -> Column:
            a_tokens = F.flatten(F.transform(aliases, tokens_en))
            return (F.when(F.coalesce(q, F.lit("")) == "", 0)
                    .when(F.array_contains(phrases, q) | F.arrays_overlap(phrases, aliases), 2)
                    .when(F.arrays_overlap(tokens, q_tokens) | F.arrays_overlap(stems, q_stems), 1)
                    .when(F.arrays_overlap(tokens, a_tokens) | F.arrays_overlap(stems, F.transform(a_tokens, stem_en)), 1)
                    .otherwise(0))
        return let(_aliases(q), by_alias)
    return let(F.struct(norm_tag(query).alias("q"), tag_phrases(tags, attrs).alias("phrases"), tag_tokens(tags).alias("tokens")), score)


def combination_score(tags, combos=rules.TAG_COMBINATIONS) -> Column:
    """Product of the weights of combinations whose tags are all present."""
    score = F.lit(1.0)
    for _, needed, weight in combos:
        complete = F.size(F.array_except(F.array(*[F.lit(t) for t in needed]), col(tags))) == 0
        score = score * F.when(complete, F.lit(weight)).otherwise(F.lit(1.0))
    return score


# ---- small classifiers ------------------------------------------------------------------------

def price_from_words(text, table=rules.PRICE_WORDS_RECIPE, default: int | None = None) -> Column:
    """First level with a listed word, in level order."""
    def levels(low: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("int"))
        for level, words in table:
            chain = chain.when(inside(low, words), F.lit(level))
        return chain.otherwise(F.lit(default).cast("int"))
    return let(F.lower(F.coalesce(col(text), F.lit(""))), levels)


def first_listed(text, names: list[str], title: bool = False) -> Column:
    """First name of the list contained in the text, null if none."""
    def branches(low: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for name in names:
            chain = chain.when(low.contains(name.lower()), F.lit(name.title() if title else name))
        return chain
    return let(F.lower(F.coalesce(col(text), F.lit(""))), branches)


def first_listed_value(text, table: dict[str, float], other: float, missing: float) -> Column:
    """Value of the first key contained in the lower-cased text."""
    low = F.lower(col(text))
    chain = F.when(F.coalesce(col(text), F.lit("")) == "", F.lit(missing))
    for key, value in table.items():
        chain = chain.when(low.contains(key), F.lit(value))
    return chain.otherwise(F.lit(other))


def pick_tags(badges, title, description) -> Column:
    """``Picks`` when a badge or the text says so."""
    badge = contains_any(F.lower(F.coalesce(col(badges), F.lit(""))), rules.PICK_BADGES)
    text = contains_any(F.lower(F.concat_ws(" ", col(title), col(description))), rules.PICK_WORDS)
    return F.when(badge | text, F.array(F.lit("Picks"))).otherwise(_empty())


def title_hint(title) -> Column:
    low = F.lower(F.coalesce(col(title), F.lit("")))
    chain = F.when(F.lit(False), F.lit(""))
    for hint, words in rules.TITLE_HINTS:
        chain = chain.when(low.rlike(alternation(words)), F.lit(hint))
    return chain.otherwise(F.lit("events"))


def title_tags(title) -> Column:
    low = F.lower(F.coalesce(col(title), F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(alternation(words)), F.lit(tag))
                                     for tag, words in rules.TITLE_TAGS]))


def typical_time(category) -> Column:
    return F.when(contains_any(F.lower(col(category)), rules.EVENING_CATEGORIES), "evening").otherwise("day")


def flags_for_query(query, table: dict[str, list[str]] = rules.QUERY_FLAGS) -> Column:
    """Flags of every topic named by the query, or one of whose flags it names; sorted."""
    low = F.lower(F.trim(F.coalesce(col(query), F.lit(""))))
    hits = [F.when(low.rlike(alternation([key, *flags])), F.array(*[F.lit(f) for f in flags])).otherwise(_empty())
            for key, flags in table.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*hits))))


def shown_image(image, category, images=rules.DEFAULT_IMAGES, default: str = rules.DEFAULT_IMAGE) -> Column:
    """The row's image, else that of its category, else the default."""
    low = F.lower(F.coalesce(col(category), F.lit("")))
    chain = F.when(F.lit(False), default)
    for words, name in images:
        chain = chain.when(inside(low, words), name)
    return F.coalesce(col(image), chain.otherwise(default))
