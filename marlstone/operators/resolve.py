"""One outcome per subject, out of its history and its candidacies, for all subjects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(subjects: DataFrame, history: DataFrame, candidacies: DataFrame, key: str, awarded: str, known: list[str]) -> DataFrame:
    """(key, outcome, decided_by): the latest award with an assignment wins; else the newest
    status, if known; else a selected candidacy; else any candidacy; else no_data.

    history has id, status, at and n_assigned; candidacies has selected. An award
    without assignment and an unknown status fall through.
    """
    order = F.struct("at", "id")
    past = history.groupBy(key).agg(
        F.max_by("id", F.when((F.col("status") == awarded) & (F.col("n_assigned") > 0), order)).alias("award_id"),
        F.max_by(F.struct("status", "id"), order).alias("newest"),
    )
    tried = candidacies.groupBy(key).agg(F.bool_or("selected").alias("any_selected"))
    rows = subjects.select(key).join(past, key, "left").join(tried, key, "left")
    by_status = F.col("newest.status").isin(*known) & (F.col("newest.status") != awarded)
    outcome = (
        F.when(F.col("award_id").isNotNull(), awarded)
        .when(by_status, F.col("newest.status"))
        .when(F.col("any_selected"), "selected_candidate")
        .when(F.col("any_selected").isNotNull(), "candidate")
        .otherwise("no_data")
    )
    return rows.select(key, outcome.alias("outcome"), F.coalesce("award_id", F.when(by_status, F.col("newest.id"))).alias("decided_by"))
