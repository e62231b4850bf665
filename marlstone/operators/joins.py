"""Equi-joins on keys that are derived, null-safe, or only partly given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_derived_key(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, how: str = "inner") -> DataFrame:
    """Join on keys computed first, so Spark sees a plain equality. Empty keys match nothing."""
    a = left.withColumn("__key", F.nullif(left_key, F.lit("")))
    b = right.withColumn("__key", F.nullif(right_key, F.lit("")))
    return a.join(b, "__key", how).drop("__key")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null equals null; Spark hashes these keys too."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(renamed, condition, how).drop(*(f"__{c}" for c in on))


def with_optional_key(left: DataFrame, right: DataFrame, on: list[str], optional: str) -> DataFrame:
    """Join on keys of which one counts only where the left row has it.

    Two equi-joins, united; one join with an OR would lose the key.
    """
    given = left.where(F.col(optional).isNotNull()).join(right, [*on, optional])
    rest = right.withColumnRenamed(optional, f"right_{optional}")
    free = left.where(F.col(optional).isNull()).join(rest, on)
    return given.withColumn(f"right_{optional}", F.col(optional)).unionByName(free)
