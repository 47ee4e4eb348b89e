"""Normalisation steps: a list of DataFrame -> DataFrame functions that can be switched and extended."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as X

Step = Callable[[DataFrame], DataFrame]


def clean_title(x: Column | str, limit: int = rules.MAX_TITLE, city: bool = False) -> Column:
    base = X.strip(X.collapse_spaces(X.strip_tags(x)))
    return F.when(base == "", base).otherwise(X.truncate_dots(X.expand_abbreviations(X.title_case(base), city=city), limit))


def clean_description(x: Column | str) -> Column:
    base = X.strip(X.collapse_spaces(X.strip_tags(x)))
    base = F.regexp_replace(base, r"(?U)[^\w\s\-.,!?()&]", "")
    base = F.regexp_replace(F.regexp_replace(base, r"\.{2,}", "."), "-{2,}", "-")
    return X.truncate_dots(base, rules.MAX_DESCRIPTION)


def _keep_original(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """A step that yields null keeps the original value."""
    return df.withColumns({c: F.coalesce(v, F.col(c)) for c, v in changes.items()})


def base_step(df: DataFrame) -> DataFrame:
    return _keep_original(df, {"name": clean_title("name"), "description": clean_description("description"), "area": clean_title("area", rules.MAX_AREA)})


def list_step(df: DataFrame) -> DataFrame:
    return _keep_original(df, {"tags": X.tag_list("tags", "-"), "flags": X.tag_list("flags", "_")})


def city_step(area_dim: DataFrame) -> Step:
    """Standard area names and removal of marketing phrases."""
    from .lookups import standard_areas

    def run(df: DataFrame) -> DataFrame:
        out = standard_areas(df, "area", area_dim)
        return (out.withColumn("area", X.remove_patterns("standard_area", rules.AREA_CLEANUP)).drop("standard_area")
                .withColumn("description", X.remove_patterns("description", rules.DESCRIPTION_CLEANUP)))
    return run


def phrase_step(df: DataFrame) -> DataFrame:
    return _keep_original(df, {"area": X.remove_patterns("area", rules.AREA_CLEANUP), "description": X.remove_patterns("description", rules.DESCRIPTION_CLEANUP)})


@dataclass(frozen=True)
class NamedStep:
    name: str
    run: Step
    enabled: bool = True


@dataclass(frozen=True)
class Normalizer:
    """An ordered list of steps; every change gives a new list."""
    steps: tuple[NamedStep, ...] = (NamedStep("base", base_step), NamedStep("lists", list_step), NamedStep("phrases", phrase_step))

    def with_step(self, name: str, run: Step) -> "Normalizer":
        return Normalizer((*self.steps, NamedStep(name, run)))

    def enable(self, name: str, enabled: bool = True) -> "Normalizer":
        return Normalizer(tuple(replace(s, enabled=enabled) if s.name == name else s for s in self.steps))

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            if step.enabled:
                df = df.transform(step.run)
        return df


def check_normalized(name: str = "name", description: str = "description", area: str = "area") -> dict[str, Column]:
    """Warnings, errors, validity and score (from 1 downwards) of a normalised row."""
    def text(c):
        return F.coalesce(F.col(c), F.lit(""))
    warns, errors, loss = [], [], F.lit(0.0)

    def note(into: list, test: Column, message: Column, cost: float) -> None:
        nonlocal loss
        into.append(F.when(test, message))
        loss = loss + F.when(test, F.lit(cost)).otherwise(F.lit(0.0))
    fields = {name: rules.MAX_TITLE, description: rules.MAX_DESCRIPTION, area: rules.MAX_AREA}
    for c in fields:
        note(warns, text(c) == "", F.lit(f"Missing or empty {c}"), 0.1)
    for c, limit in fields.items():
        note(warns, F.length(text(c)) > limit, F.format_string(f"{c.capitalize()} too long: %d chars", F.length(text(c))), 0.05)
        note(errors, text(c).rlike("[<>]"), F.lit(f"HTML tags found in {c}"), 0.2)
    for c in (name, description):
        special = F.length(F.regexp_replace(text(c), r"[\p{L}\p{N} ]", ""))
        note(warns, special > F.length(text(c)) * 0.3, F.lit(f"Excessive special characters in {c}"), 0.1)
    error_list = F.array_compact(F.array(*errors))
    return {"warnings": F.array_compact(F.array(*warns)), "errors": error_list, "is_valid": F.size(error_list) == 0,
            "score": F.round(F.greatest(F.lit(1.0) - loss, F.lit(0.0)), 4)}
