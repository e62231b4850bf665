"""Dense numbers without a one-task window: sorted ranges, and prefix sums of their sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.shared import written


def numbered(rows: DataFrame, keys: list[str], name: str, first: int = 1) -> DataFrame:
    """rows with their number in the order of keys, counted from first without a gap; of equal keys in any order.

    Rows are dealt out by ranges of the keys and sorted there. A written table fixes the
    places; a row a range goes to the driver for the sums of what comes before.
    """
    place = F.monotonically_increasing_id()  # the partition, and from bit 33 down the place in it
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    told = written(dealt.withColumns({"__part": F.shiftright(place, 33), "__at": place.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    starts, before = [], first
    for part, n in sorted(told.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((part, before))
        before += n
    if not starts:
        return rows.limit(0).withColumn(name, F.lit(0).cast("long"))
    sums = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    return told.join(F.broadcast(sums), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def insert_returning_ids(old: DataFrame, new: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(id_col and new's columns) of the rows of new whose natural key old doesn't have, with ids that go on from old's greatest without a gap, in the order of keys.

    Of several new rows of a key the one whose other columns, in their order, are the
    greatest is inserted. Nulls in keys equal each other. old without rows begins at 1.
    """
    others = [c for c in new.columns if c not in keys]
    if others:
        best = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__best"))
        fresh = best.select(*keys, *(F.col(f"__best.{c}").alias(c) for c in others))
    else:
        fresh = new.distinct()
    known = old.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same: Column = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    most = old.agg(F.max(id_col)).first()[0] or 0
    return numbered(fresh.join(known, same, "left_anti"), keys, id_col, most + 1).select(id_col, *new.columns)
