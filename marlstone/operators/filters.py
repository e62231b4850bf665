"""Predicates that are there only if their argument is."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optional(value: Any, predicate: Column) -> Column | None:
    """The predicate if the value is given. None, '', 0 and False count as not given."""
    return predicate if value else None


def all_given(df: DataFrame, predicates: Iterable[Column | None]) -> DataFrame:
    """Rows that satisfy every predicate that isn't None."""
    return df.where(reduce(Column.__and__, (p for p in predicates if p is not None), F.lit(True)))


def text_range(c: Column, low: str | None, high: str | None) -> Column:
    """Bounds on text in its order, as ISO dates have it; with a bound, nulls drop out."""
    out = F.lit(True)
    if low:
        out = out & (c >= low)
    if high:
        out = out & (c <= high)
    return out


def day_range(c: Column, low: str, high: str) -> Column:
    """A time within days given as ISO dates, both included; compares the time itself, so files can be skipped by it."""
    return (c >= F.lit(low).cast("timestamp_ntz")) & (c < F.date_add(F.lit(high), 1).cast("timestamp_ntz"))


def with_flag(df: DataFrame, other: DataFrame, on: list[str], wanted: bool | None) -> DataFrame:
    """Rows that have (True) or lack (False) a match in other; all of them for None."""
    if wanted is None:
        return df
    return df.join(other, on, "left_semi" if wanted else "left_anti")


def available(status: Column, include_all: bool, default: str = "available") -> Column:
    """The default guard on a status; a null status counts as the default."""
    return F.lit(True) if include_all else F.coalesce(status, F.lit(default)) == default


def require(value: str, least: int) -> str:
    if len(value.strip()) < least:
        raise ValueError(f"a search takes {least} characters at least")
    return value
