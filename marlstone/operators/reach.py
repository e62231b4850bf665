"""Bounded breadth-first reach over a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.shared import written


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int, source: str = "source", target: str = "target") -> DataFrame:
    """(node, depth) within max_depth links of a seed, at its least depth.

    Each step joins the frontier with the links and drops what was seen, so a node is
    expanded once.
    """
    seen = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        frontier = seen.where(F.col("depth") == depth - 1)
        found = frontier.join(links, frontier["node"] == links[source]).select(F.col(target).alias("node")).distinct()
        seen = seen.unionByName(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
    return seen


def reachable_far(links: DataFrame, seeds: DataFrame, max_depth: int, source: str = "source", target: str = "target") -> DataFrame:
    """The same, for walks of many steps: each step's new nodes are a written table, so no plan holds those of all steps.

    It ends before max_depth where a step finds nothing new. Links and seeds with nulls lead nowhere.
    """
    edges = written(links.select(F.col(source).alias("__from"), F.col(target).alias("__to")).where("__from is not null and __to is not null").distinct(), "links")
    frontier = written(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)), "reached")
    seen = [frontier]
    for depth in range(1, max_depth + 1):
        known = seen[0]
        for part in seen[1:]:
            known = known.unionByName(part)
        found = frontier.join(edges, F.col("node") == F.col("__from")).select(F.col("__to").alias("node")).distinct()
        frontier = written(found.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    out = seen[0]
    for part in seen[1:]:
        out = out.unionByName(part)
    return out
