"""Line streams: texts as ordered lines, with what a line inherits from those before it.

Every window is partitioned by document, so documents are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), line_no from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _so_far(key: str):
    return Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry_forward(rows: DataFrame, key: str, is_heading: Column, heading: Column, name: str) -> DataFrame:
    """The last heading at or before each line; null before the first."""
    return rows.withColumn(name, F.last(F.when(is_heading, heading), ignorenulls=True).over(_so_far(key)))


def with_next(rows: DataFrame, key: str, name: str = "next_line") -> DataFrame:
    return rows.withColumn(name, F.lead("line").over(Window.partitionBy(key).orderBy("line_no")))


def numbered_blocks(rows: DataFrame, key: str, is_start: Column, name: str = "block_no") -> DataFrame:
    """Blocks counted from 1 by their start lines; 0 before the first."""
    return rows.withColumn(name, F.sum(F.when(is_start, 1).otherwise(0)).over(_so_far(key)))


def changed_from_previous(rows: DataFrame, key: str, value: str) -> Column:
    """Whether a line's value differs from the one before it, for headings that are repeated on a new page."""
    before = F.last(F.col(value), ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return F.col(value).isNotNull() & ~F.col(value).eqNullSafe(before)


def gated(rows: DataFrame, key: str, opens: Column) -> DataFrame:
    """Lines after one that opens the gate; none of documents without such a line."""
    return rows.withColumn("__open", F.max(opens.cast("int")).over(_so_far(key))).where("__open = 1").where(~opens).drop("__open")


def block_texts(rows: DataFrame, key: str, block: str = "block_no") -> DataFrame:
    """(key, block, n_lines, row_text): the lines of each block, joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(key, block).agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(parts, lambda x: x["line"]), " ").alias("row_text"))


def block_fields(rows: DataFrame, keys: list[str], name: str, value: Column, matches: Column, kinds: dict[str, Column]) -> DataFrame:
    """(keys, name, kinds): the value of a block's last line that matches, and the first line of each kind.

    Null where no line does. A kind takes its lines with no regard to the others'.
    """
    last = F.max_by(value, F.when(matches, F.col("line_no")))
    firsts = [F.min_by("line", F.when(is_kind, F.col("line_no"))).alias(kind) for kind, is_kind in kinds.items()]
    return rows.groupBy(*keys).agg(last.alias(name), *firsts)


def regex_rows(docs: DataFrame, key: str, text: Column, pattern: str, groups: list[str]) -> DataFrame:
    """A row for each match in a text, with its groups as columns and its number in order."""
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)))
    return docs.select(key, F.posexplode(found).alias("row_no", "__row")).select(key, "row_no", *(F.col(f"__row.{g}").alias(g) for g in groups))
