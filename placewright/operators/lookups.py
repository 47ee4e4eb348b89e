"""Joins against rule tables: synonyms, categories, areas, related tags.

Rule tables are loaded from files and their size is checked before they are broadcast; a larger table joins
by its key instead.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import jaccard, word_set

BROADCAST_BYTES = 64 << 20


def sized(dim: DataFrame) -> DataFrame:
    """The table with a broadcast hint if the optimizer's bound on its bytes is small; else it joins by its key.

    The bound is known when the plan is built, so no job runs here; without a known bound Spark decides by the size it measures.
    """
    known = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(dim) if known <= BROADCAST_BYTES else dim


def synonym_map(tag_dim: DataFrame, synonym_dim: DataFrame, on_conflict: str = "last") -> DataFrame:
    """(word, category): each lower-cased synonym once; ``on_conflict`` picks the last or first listed category."""
    order = F.struct("ord", "category")
    pick = F.max_by if on_conflict == "last" else F.min_by
    words = synonym_dim.select(F.lower("synonym").alias("word"), "category", "ord")
    return words.groupBy("word").agg(pick("category", order).alias("category"))


def normalize_tags(df: DataFrame, ident: str, tags: str, tag_dim: DataFrame, synonyms: DataFrame, out: str = "canonical") -> DataFrame:
    """Tags replaced by their category (exact name first, then synonym), unknown tags kept, unique ignoring case."""
    pairs = _canonical(df, ident, tags, tag_dim, synonyms)
    first = (pairs.withColumn("_val", F.coalesce("category", "tag")).groupBy(ident, F.lower("_val").alias("_low"))
             .agg(F.min(F.struct("pos", "_val")).alias("_at")))
    lists = first.groupBy(ident).agg(F.transform(F.array_sort(F.collect_list("_at")), lambda s: s["_val"]).alias(out))
    return df.join(lists, ident, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def _canonical(df: DataFrame, ident: str, tags: str, tag_dim: DataFrame, synonyms: DataFrame) -> DataFrame:
    one = df.select(ident, F.posexplode(tags).alias("pos", "tag")).where(F.coalesce(F.col("tag"), F.lit("")) != "")
    exact = sized(tag_dim.select(F.col("category").alias("tag"), F.col("category").alias("_exact")))
    syn = sized(synonyms.select(F.col("word").alias("_word"), F.col("category").alias("_syn")))
    return (one.join(exact, "tag", "left").join(syn, F.lower("tag") == F.col("_word"), "left")
            .select(ident, "pos", "tag", F.coalesce("_exact", "_syn").alias("category")))


def validate_tags(df: DataFrame, ident: str, tags: str, tag_dim: DataFrame, synonyms: DataFrame,
                  limits: dict[str, int] = rules.TAG_LIMITS) -> DataFrame:
    """Counts per level, unknown tags, error and warning lists, validity."""
    levels = sized(tag_dim.select("category", "level"))
    pairs = _canonical(df, ident, tags, tag_dim, synonyms).join(levels, "category", "left")
    counts = pairs.groupBy(ident).agg(
        F.count_if(F.col("level") == "A").alias("level_a"), F.count_if(F.col("level") == "B").alias("level_b"),
        F.count_if(F.col("level").isNull()).alias("unknown"))
    out = df.select(ident, F.size(tags).alias("total_tags")).join(counts, ident, "left").na.fill(0)
    too_many, too_few = F.col("total_tags") > limits["max_tags"], F.col("total_tags") < limits["min_tags"]
    no_a = F.col("level_a") < limits["min_level_a"]
    return (out.withColumn("errors", F.array_compact(F.array(
                F.when(too_many, F.format_string(f"Too many tags: %d > {limits['max_tags']}", F.col("total_tags"))),
                F.when(no_a, F.format_string(f"Not enough level A tags: %d < {limits['min_level_a']}", F.col("level_a"))))))
            .withColumn("warnings", F.array_compact(F.array(
                F.when(too_few, F.format_string(f"Too few tags: %d < {limits['min_tags']}", F.col("total_tags"))),
                F.when(F.col("unknown") > 0, F.format_string("Unknown tags: %d", F.col("unknown"))))))
            .withColumn("is_valid", F.size("errors") == 0))


def suggest_categories(words: DataFrame, word: str, synonym_dim: DataFrame, above: float = 0.6, top: int = 3) -> DataFrame:
    """(word, category, rank) for words that share enough words with a synonym; by name, at most ``top``."""
    syn = synonym_dim.select("category", word_set("synonym").alias("_s"))
    tokens = syn.select("category", "_s", F.explode("_s").alias("_w"))
    mine = words.select(word).distinct().withColumn("_q", word_set(word)).withColumn("_w", F.explode("_q"))
    hits = mine.join(sized(tokens), "_w").where(jaccard("_q", "_s") > above).select(word, "category").distinct()
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(word).orderBy("category")))
    return ranked.where(F.col("rank") <= top)


def tag_info(df: DataFrame, tag: str, tag_dim: DataFrame, synonym_dim: DataFrame, synonyms: DataFrame, language: str = "en") -> DataFrame:
    """Category, level, priority and the synonyms of one language for each tag."""
    lists = synonym_dim.where(F.col("language") == language).groupBy("category").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "synonym"))), lambda s: s["synonym"]).alias("synonyms"))
    info = sized(tag_dim.join(lists, "category", "left"))
    exact = sized(tag_dim.select(F.col("category").alias("_exact")))
    syn = sized(synonyms.select(F.col("word").alias("_word"), F.col("category").alias("_syn")))
    found = (df.join(exact, F.col(tag) == F.col("_exact"), "left").join(syn, F.lower(tag) == F.col("_word"), "left")
             .withColumn("category", F.coalesce("_exact", "_syn")).drop("_exact", "_word", "_syn"))
    return found.join(info, "category", "left")


def related_tags(tag_dim: DataFrame, span: int = 2, top: int = 5) -> DataFrame:
    """(category, related, rank): same level, priority within the span, by priority then listing order."""
    a = tag_dim.select("category", "level", F.col("priority").alias("_p"), F.explode(
        F.sequence(F.col("priority") - span, F.col("priority") + span)).alias("priority"))
    b = tag_dim.select(F.col("category").alias("related"), "level", "priority", "ord")
    pairs = a.join(b, ["level", "priority"]).where(F.col("related") != F.col("category"))
    w = Window.partitionBy("category").orderBy("priority", "ord", "related")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("category", "related", "rank")


def search_tags(tag_dim: DataFrame, synonym_dim: DataFrame, query: str, language: str = "en", top: int = 10) -> DataFrame:
    """2.0 name + 1.0 description + 1.5 synonym of the language; best first."""
    q = query.lower()
    syn = (synonym_dim.where((F.col("language") == language.lower()) & F.lower("synonym").contains(q))
           .select("category").distinct().withColumn("_hit", F.lit(1)))
    score = (F.when(F.lower("category").contains(q), 2.0).otherwise(0.0) + F.when(F.lower("description").contains(q), 1.0).otherwise(0.0)
             + F.when(F.col("_hit").isNotNull(), 1.5).otherwise(0.0))
    return (tag_dim.join(syn, "category", "left").withColumn("score", score).where("score > 0")
            .orderBy(F.desc("score"), "ord", "category").limit(top).select(F.col("category").alias("tag"), "score", "level", "priority"))


def tag_statistics(tag_dim: DataFrame, synonym_dim: DataFrame) -> DataFrame:
    tags = tag_dim.agg(F.count(F.lit(1)).alias("total_categories"), F.count_if(F.col("level") == "A").alias("level_a_count"),
                       F.count_if(F.col("level") == "B").alias("level_b_count"))
    syn = synonym_dim.agg(F.count(F.lit(1)).alias("total_synonyms"), F.count_if(F.col("language") == "en").alias("en_synonyms"),
                          F.count_if(F.col("language") == "th").alias("th_synonyms"))
    return tags.withColumn("_one", F.lit(1)).join(syn.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn(
        "average_synonyms", F.round(F.try_divide("total_synonyms", "total_categories"), 2))


# ---- categories ------------------------------------------------------------------------------

def rule_table(spark, table: dict[str, list[str]], key: str, value: str) -> DataFrame:
    rows = [(k, v, i) for i, (k, vs) in enumerate(table.items()) for v in vs]
    return spark.createDataFrame(rows, f"{key} string, {value} string, ord int")


def category_facets(df: DataFrame, ident: str, categories: str, aliases=rules.CATEGORY_ALIASES, flags=rules.CATEGORY_FLAGS) -> DataFrame:
    """(ident, categories, flags): chosen categories plus one alias hop, and the flags of both, sorted."""
    spark = df.sparkSession
    one = df.select(ident, F.explode(categories).alias("_c")).select(ident, F.lower("_c").alias("category")).distinct()
    alias = F.broadcast(rule_table(spark, aliases, "category", "alias").drop("ord"))
    wide = one.unionByName(one.join(alias, "category").select(ident, F.col("alias").alias("category"))).distinct()
    flag = F.broadcast(rule_table(spark, flags, "category", "flag").drop("ord"))
    with_flag = wide.join(flag, "category", "left")
    return with_flag.groupBy(ident).agg(F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("flag")).alias("flags"))


def never_empty_flags(flags, categories):
    """The flags, else art when any category names it, else all."""
    return (F.when(F.size(F.col(flags)) > 0, F.col(flags))
            .when(F.exists(F.col(categories), lambda c: c.contains("art")), F.array(F.lit("art"))).otherwise(F.array(F.lit("all"))))


def category_tags(df: DataFrame, ident: str, categories: str, category_dim: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """(ident, tags): tags of the chosen categories that are allowed, sorted. ``category_dim`` has id and tags."""
    one = df.select(ident, F.explode(categories).alias("id")).join(sized(category_dim), "id").select(ident, F.explode("tags").alias("tag")).distinct()
    if allowed is not None:
        one = one.where(F.col("tag").isin(allowed))
    return one.groupBy(ident).agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def attach_by_name(df: DataFrame, name: str, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Dimension columns by name ignoring case."""
    d = dim.withColumn("_k", F.lower(key)).drop(key)
    return df.join(sized(d), F.lower(name) == F.col("_k"), how).drop("_k")


# ---- areas -----------------------------------------------------------------------------------

def _grams(text: str, size) -> Column:
    """The distinct runs of ``size`` letters of a text; none where it is shorter."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(F.col(text), i, size)))


def contained_candidates(inner: DataFrame, outer: DataFrame, size: int = 3) -> DataFrame:
    """(inner, outer) of distinct texts that share the rarest letter group of the inner one, by counts over the outer ones.

    One key per inner text, so a common group brings nothing together as long as a rarer one is there; an inner text with a group that no
    outer one has is out at once. Texts shorter than a group are groups of their own length.
    """
    own = inner.select("inner", F.least(F.length("inner"), F.lit(size)).alias("_q")).withColumn("_g", F.explode(_grams("inner", F.col("_q"))))
    held = outer.select("outer", F.explode(F.array_distinct(F.concat(*[_grams("outer", F.lit(q)) for q in range(1, size + 1)]))).alias("_g"))
    counts = held.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = own.join(counts, "_g", "left").groupBy("inner").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("_r")).where("_r.n > 0")
    met = rarest.select("inner", F.col("_r.g").alias("_g")).join(held, "_g")
    return met.where(F.length("inner") <= F.length("outer")).select("inner", "outer")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of distinct texts where the outer one holds the inner one."""
    return contained_candidates(inner, outer).where(F.col("outer").contains(F.col("inner")))


def standard_areas(df: DataFrame, area: str, area_dim: DataFrame, out: str = "standard_area") -> DataFrame:
    """Standard area by exact synonym, then by containment either way, in listing order; unknown text is kept.

    Areas are reduced to their distinct spellings first, so the containment test runs once per spelling, and only for those
    that no synonym equals.
    ``area_dim``: area, synonym, ord.
    """
    low = F.lower(F.trim(area))
    spellings = df.select(low.alias("_a")).where(F.length("_a") > 0).distinct()
    exact = area_dim.groupBy("synonym").agg(F.min_by("area", "ord").alias("_exact"))
    first = spellings.join(sized(exact), F.col("_a") == F.col("synonym"), "left").drop("synonym")
    missing = first.where(F.col("_exact").isNull()).select("_a")

    names = area_dim.where(F.length("synonym") > 0)
    inside = contained(names.select(F.col("synonym").alias("inner")).distinct(), missing.select(F.col("_a").alias("outer"))).select(
        F.col("outer").alias("_a"), F.col("inner").alias("synonym"))
    around = contained(missing.select(F.col("_a").alias("inner")), names.select(F.col("synonym").alias("outer")).distinct()).select(
        F.col("inner").alias("_a"), F.col("outer").alias("synonym"))
    both = inside.unionByName(around).join(names, "synonym").groupBy("_a").agg(F.min_by("area", "ord").alias("_part"))
    known = first.join(both, "_a", "left").select("_a", F.initcap(F.coalesce("_exact", "_part")).alias("_std")).where("_std is not null")
    return df.join(known, low == F.col("_a"), "left").withColumn(out, F.coalesce("_std", area)).drop("_a", "_std")


def exact_areas(df: DataFrame, area: str, area_dim: DataFrame) -> DataFrame:
    """Standard name, known mark and all synonyms of the standard name, by exact lookup."""
    low = F.lower(F.trim(area))
    exact = area_dim.groupBy(F.col("synonym").alias("_s")).agg(F.min_by("area", "ord").alias("standard"))
    names = area_dim.groupBy(F.col("area").alias("standard")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "synonym"))), lambda s: s["synonym"]).alias("synonyms"))
    return (df.join(sized(exact), low == F.col("_s"), "left").drop("_s").join(sized(names), "standard", "left").withColumn("is_known", F.col("standard").isNotNull()))


def area_types(area_dim: DataFrame, types=rules.AREA_TYPES) -> DataFrame:
    """(type, areas, synonyms, mean_synonyms) of the area dimension; areas of no listed type are ``other``."""
    low = F.lower("area")
    kind = F.when(F.lit(False), "")
    for words, name in types:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        kind = kind.when(test, name)
    per = area_dim.groupBy("area").agg(F.count(F.lit(1)).alias("n")).withColumn("type", kind.otherwise("other"))
    return per.groupBy("type").agg(F.count(F.lit(1)).alias("areas"), F.sum("n").alias("synonyms"), F.round(F.avg("n"), 2).alias("mean_synonyms"))
