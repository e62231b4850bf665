"""Writers: reports, bulk tables, partition-wise replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bulk(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One write for all rows, in place of one statement for each."""
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Only the partitions that df has rows for are written anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def with_json(df: DataFrame, fields: list[str], name: str = "payload") -> DataFrame:
    return df.withColumn(name, F.to_json(F.struct(*fields)))
