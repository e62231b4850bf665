"""Linking rows to candidates that are narrowed step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, REFINED, AMBIGUOUS, NO_MATCH = "exact", "refined", "ambiguous", "no_match"


def narrowed(pairs: DataFrame, key: str, steps: list[Column], weight: Column | None = None) -> DataFrame:
    """Candidate pairs left after each step in turn; a step that would leave none is skipped.

    All steps share one partitioning by key. Adds n_first, the candidates at the start.
    weight is how many candidates a pair stands for, one if not given: candidates that
    no step tells apart go as one pair.
    """
    per_key, each = Window.partitionBy(key), F.lit(1) if weight is None else weight
    out = pairs.withColumn("n_first", F.sum(each).over(per_key))
    for step in steps:
        hit = F.coalesce(step, F.lit(False))
        out = out.withColumn("__hit", hit).withColumn("__any", F.max("__hit").over(per_key))
        out = out.where("__hit or not __any").drop("__hit", "__any")
    return out.withColumn("n_left", F.sum(each).over(per_key))


def matched(wanted: DataFrame, pairs: DataFrame, key: str, candidate: str, steps: list[Column], weight: Column | None = None) -> DataFrame:
    """(key, status, candidate) for every wanted row; a candidate only where one is left."""
    left = narrowed(pairs, key, steps, weight)
    told = left.groupBy(key).agg(F.max("n_first").alias("n_first"), F.max("n_left").alias("n_left"), F.min(candidate).alias(candidate))
    status = F.when(F.col("n_left").isNull(), NO_MATCH).when(F.col("n_first") == 1, EXACT).when(F.col("n_left") == 1, REFINED).otherwise(AMBIGUOUS)
    out = wanted.select(key).join(told, key, "left")
    return out.select(key, status.alias("status"), F.when(F.col("n_left") == 1, F.col(candidate)).alias(candidate))
