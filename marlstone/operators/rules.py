"""Ordered rules: the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; a null condition doesn't."""
    out = F.when(F.lit(False), default)
    for condition, name in rules:
        out = out.when(condition, name)
    return out.otherwise(default)


def has_any(text: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def count_markers(text: Column, markers: list[str]) -> Column:
    """How many different markers occur in a text."""
    return F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)))


def at_least(text: Column, markers: list[str], n: int) -> Column:
    return count_markers(text, markers) >= n


def evidence(*parts: Column) -> Column:
    """Everything a rule may look at, in one text; nulls leave no trace."""
    return F.concat_ws(" ", *parts)


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def relevant(text: Column, against: list[str], in_favour: list[str]) -> Column:
    """One marker against is a veto; else one in favour suffices."""
    return ~has_any(text, against) & has_any(text, in_favour)


def inferred(candidates: list[tuple[str, Column, Column]]) -> Column:
    """Struct (origin, text, value) of the first candidate (origin, text, value) that has a text.

    A text that can't be read keeps its place with a null value, as what is found first
    is what the document says, readable or not. All null where no candidate has a text.
    """
    told = [F.when(F.coalesce(text, F.lit("")) != "", F.struct(F.lit(origin).alias("origin"), text.alias("text"), value.alias("value"))) for origin, text, value in candidates]
    return F.coalesce(*told)
