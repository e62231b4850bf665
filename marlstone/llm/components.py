"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so no neighbour list is ever
gathered. Hubs aren't shuffled for the join: nodes with more than 1 / HUBS of all edge
ends number less than HUBS, so their minima are broadcast. The edge table of a step is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import stash

#: Nodes whose minimum may be broadcast, at most.
HUBS = 5000


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _least(ends: DataFrame) -> DataFrame:
    """(u, m, n): of each node its least neighbour and how many rows it has."""
    return ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _join_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """(u, v, m) of every edge; least counts `ends` rows in all, so less than HUBS nodes have more than ends / HUBS."""
    hub = F.col("n") > F.lit(ends / HUBS)
    hubs = least.where(hub).select("u", F.col("m").alias("hub_m"))
    told = edges.join(F.broadcast(hubs), "u", "left")
    rest = told.where("hub_m is null").join(least.where(~hub).select("u", "m"), "u").select("u", "v", "m")
    return told.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = _least(edges.unionByName(turned)).withColumn("m", F.least("u", "m"))
    return _join_least(turned, least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = _least(edges)
    moved = _join_least(edges, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of a link that isn't its component's least node.

    Loops, repeated links and links in either direction are allowed; links with a
    null end are ignored. An empty link table gives an empty result.
    """
    edges = (
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges = stash(edges, "edges")
    seen = _checksum(edges)
    while seen[0]:
        edges = stash(_small_star(stash(_large_star(edges, seen[0]), "stars", seen[0]), seen[0]).where("u <> v").distinct(), "edges", seen[0])
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
