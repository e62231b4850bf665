"""Hash trees over the rows of a group: blocks of neighbouring ids, a digest a block, digests of digests.

A block holds the ids of one span of fixed width, so no array outgrows the span however
many rows a group has, and a row that is changed, added or gone changes its own block
and what lies above it only. Two states of a group are equal if their roots are; where
they differ, the blocks that differ are found by comparing levels downward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(rows: DataFrame, group: list[str], key: str, content: Column, size: int = 64) -> DataFrame:
    """(group, block_no, n, ids, digest): a row for each span of `size` ids that has rows. key is an integer.

    A block's digest is the SHA-256 of id:digest of each different (id, content) in it, by
    id, joined by commas; a null content is an empty one, and rows with a null id are
    left out. Rows that repeat both count once.
    """
    one = F.struct(F.col(key).cast("long").alias("id"), F.sha2(F.coalesce(content.cast("binary"), F.lit("").cast("binary")), 256).alias("digest"))
    block = F.floor(F.col(key) / size).cast("long").alias("block_no")
    found = rows.where(F.col(key).isNotNull()).groupBy(*group, block).agg(F.array_sort(F.collect_set(one)).alias("rows"))
    entry = F.transform("rows", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["digest"]))
    ids = F.array_join(F.array_distinct(F.transform("rows", lambda r: r["id"].cast("string"))), ",")
    return found.select(*group, "block_no", F.size("rows").cast("long").alias("n"), ids.alias("ids"), F.sha2(F.array_join(entry, ","), 256).alias("digest"))


def parents(level: DataFrame, group: list[str], fan: int = 64) -> DataFrame:
    """The level above: (group, block_no, n, digest) of each `fan` neighbouring blocks, the SHA-256 of their digests by number, joined by commas."""
    own = F.array_sort(F.collect_list(F.struct("block_no", "digest")))
    found = level.groupBy(*group, F.floor(F.col("block_no") / fan).cast("long").alias("parent")).agg(F.sum("n").alias("n"), own.alias("own"))
    return found.select(*group, F.col("parent").alias("block_no"), "n", F.sha2(F.array_join(F.transform("own", lambda b: b["digest"]), ","), 256).alias("digest"))


def tree(bottom: DataFrame, group: list[str], fan: int = 64, levels: int = 3) -> list[DataFrame]:
    """The levels above the blocks, lowest first, and last the roots: (group, n, digest).

    With ids that lie close a root has at most ids / (size * fan ** levels) children, or
    two; levels is to be chosen so that these are few.
    """
    out = []
    level = bottom
    for _ in range(levels):
        level = parents(level, group, fan)
        out.append(level)
    top = F.array_sort(F.collect_list(F.struct("block_no", "digest")))
    roots = level.groupBy(*group).agg(F.sum("n").alias("n"), top.alias("own"))
    out.append(roots.select(*group, "n", F.sha2(F.array_join(F.transform("own", lambda b: b["digest"]), ","), 256).alias("digest")))
    return out


def changed_blocks(before: DataFrame, now: DataFrame, group: list[str], fan: int = 64, levels: int = 3) -> DataFrame:
    """(group, block_no, change): blocks that were `added`, `removed` or `changed`, of groups that both states have.

    From the roots downward only what lies under a difference is compared.
    """
    old, new = (tree(x, group, fan, levels) for x in (before, now))

    def unequal(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
        pairs = a.select(*keys, F.col("digest").alias("old")).join(b.select(*keys, F.col("digest").alias("new")), keys, how)
        return pairs.where(~F.col("old").eqNullSafe(F.col("new")))

    open_nodes = unequal(old[-1], new[-1], group, "inner").select(*group)
    keys = [*group]
    for a, b in zip([*reversed(old[:-1]), before], [*reversed(new[:-1]), now]):
        below = [x if len(keys) == len(group) else x.withColumn("parent", F.floor(F.col("block_no") / fan).cast("long")) for x in (a, b)]
        under = [x.join(open_nodes, keys, "left_semi").drop("parent") for x in below]
        found = unequal(*under, [*group, "block_no"], "full")
        open_nodes, keys = found.select(*group, F.col("block_no").alias("parent")), [*group, "parent"]
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return found.select(*group, "block_no", change.alias("change"))
