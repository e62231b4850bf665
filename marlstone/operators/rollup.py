"""Counts beside their parents, unions aggregated again, latest and first rows of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_child_counts(parent: DataFrame, child: DataFrame, on: list[str], **aggregates: Column) -> DataFrame:
    """Parents with aggregates over their children, which are aggregated before the join.

    Aggregates whose name starts with n_ are 0 for a parent without children.
    """
    sums = child.groupBy(*on).agg(*(a.alias(n) for n, a in aggregates.items()))
    out = parent.join(sums, on, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in aggregates if n.startswith("n_")})


def union_reaggregate(parts: list[DataFrame], keys: list[str], sums: list[str], maxima: list[str], kind: str | None = None) -> DataFrame:
    """Partial aggregates of several sources, united and aggregated again.

    A part that lacks a column has null there. kind, if given, is listed in order.
    """
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    more = [F.expr(f"listagg(DISTINCT {kind}, ',') WITHIN GROUP (ORDER BY {kind})").alias(f"{kind}s")] if kind else []
    return united.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima), *more)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def greatest_per_key(df: DataFrame, keys: list[str], by: list[str], value: list[str]) -> DataFrame:
    """The values of each key's greatest row: an aggregate, so hot keys are combined before the shuffle. Nulls in `by` come first."""
    best = F.max_by(F.struct(*by, *value), F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in by)))
    rest = [c for c in dict.fromkeys([*by, *value])]
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, *(F.col(f"__best.{c}").alias(c) for c in rest))


def options(df: DataFrame, value: str, label: Column, order: Column) -> DataFrame:
    """Distinct (value, label); the label that comes first in order wins."""
    there = df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    return there.groupBy(value).agg(F.min_by(label, order).alias("label"))


def tally(df: DataFrame, status: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """A column of counts for each status, in one pass."""
    return df.groupBy(*(by or [])).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values))


def latest_of(*dates: Column) -> Column:
    """The later of nullable dates; null only if all are."""
    return F.greatest(*dates)


def nested(parent: DataFrame, child: DataFrame, on: list[str], fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an array of structs in the order of the fields; empty where there are none."""
    lists = child.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parent.join(lists, on, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
