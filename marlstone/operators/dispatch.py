"""Parsers in a fixed order over the same texts, in one job, with tallies that decide on what follows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parser:
    """applies tells which documents it takes, rows gives the array of texts it finds in one; feeds: its success calls for the follow-up."""

    name: str
    applies: Column
    rows: Column
    feeds: bool = False


@dataclass(frozen=True)
class Tally:
    """Documents that a parser took, those of them with rows and without, and its rows."""

    taken: int
    success: int
    empty: int
    rows: int


def parsed(docs: DataFrame, key: str, parsers: list[Parser]) -> DataFrame:
    """(key, parser, place, found): for each document and parser that takes it, the rows it finds; place is the parser's in the order. A parser whose rows are null has found none."""
    each = [F.when(F.coalesce(p.applies, F.lit(False)), F.struct(F.lit(i).alias("place"), F.lit(p.name).alias("parser"), F.coalesce(p.rows, F.array().cast("array<string>")).alias("found"))) for i, p in enumerate(parsers)]
    taken = docs.select(key, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("__p"))
    return taken.select(key, "__p.place", "__p.parser", "__p.found")


def dispatch(docs: DataFrame, key: str, parsers: list[Parser], write: Callable[[DataFrame], None]) -> tuple[dict[str, Tally], bool]:
    """Write (key, parser, row_no, row_text) of all parsers by write, which must run one job; the tally of each, in their order, and whether the follow-up is due.

    The tallies are counted in that job, as the rows pass, so nothing is read twice. The
    follow-up is due if a parser that feeds it has found rows in a document.
    """
    seen = Observation("dispatch")
    counts = []
    for i, p in enumerate(parsers):
        own = F.col("place") == i
        n = F.when(own, F.size("found")).otherwise(0)
        counts += [F.count_if(own).alias(f"taken{i}"), F.count_if(own & (F.size("found") > 0)).alias(f"success{i}"), F.sum(n.cast("long")).alias(f"rows{i}")]
    rows = parsed(docs, key, parsers).observe(seen, *counts)
    write(rows.select(key, "parser", F.posexplode("found").alias("row_no", "row_text")))
    got = seen.get
    tallies = {}
    for i, p in enumerate(parsers):
        taken, success = got.get(f"taken{i}") or 0, got.get(f"success{i}") or 0
        tallies[p.name] = Tally(taken, success, taken - success, got.get(f"rows{i}") or 0)
    return tallies, any(p.feeds and tallies[p.name].success for p in parsers)


def with_followup(docs: DataFrame, key: str, parsers: list[Parser], write: Callable[[DataFrame], None], followup: Callable[[], None]) -> dict[str, Tally]:
    """dispatch, and then the follow-up if it is due."""
    tallies, due = dispatch(docs, key, parsers, write)
    if due:
        followup()
    return tallies
