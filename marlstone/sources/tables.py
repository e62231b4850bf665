"""Readers: tables, delimited files of text columns, files by content."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, as a pushed-down filter."""
    return df.where(F.col(key) == F.lit(value))


def text_columns(spark: SparkSession, path: str, required: list[str], keys: list[str]) -> DataFrame:
    """A delimited file with a header, all columns as text. Missing columns are an error; rows without a key are dropped."""
    header = spark.read.text(path).limit(1).collect()
    names = [x.strip() for x in next(csv.reader([header[0][0]], skipinitialspace=True))] if header else []
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.dropna(subset=keys)


def evolve(parts: list[DataFrame]) -> DataFrame:
    """Tables of growing schemas, united; columns that a part lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def files_by_content(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha): files with the hash of their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha"))


def changed(new: DataFrame, known: DataFrame) -> DataFrame:
    """Versions whose hash isn't known."""
    return new.join(known.select("sha"), "sha", "left_anti")


def decoded(envelopes: DataFrame, payload: str, least_bytes: int) -> DataFrame:
    """Base64 payloads as (content, sha, big_enough)."""
    content = F.unbase64(payload)
    return envelopes.select(content.alias("content"), F.sha2(content, 256).alias("sha"), (F.octet_length(content) >= least_bytes).alias("big_enough"))
