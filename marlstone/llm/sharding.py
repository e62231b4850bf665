"""Shards of near equal bytes by sampled splitters, in Spark's own functions.

The key of a record is a hash of its text, so equal texts lie side by side. A sample
drawn in proportion to size gives the key's quantiles by bytes; they part the keys into
many more ranges than shards, and a key that spans several quantiles is a range of its
own. Exact sizes of all ranges are counted; an overfull one is subdivided into pieces, by
key, or by id where it is one text. Ranges are then dealt to the shards, largest first,
each to the emptiest shard. Equal texts share a shard, unless they alone outgrow one:
then their pieces are dealt one by one. A record's slot is its place within its piece
after the pieces of its shard that come before.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from marlstone.llm.common import stash

LAW = "bytes"
#: Ranges a shard, and sampled keys a range; both bound what the driver gets.
RANGES = 512
SAMPLES = 8
#: Keys that share this many leading bits share the list of splitters they are held against.
LEAD = 12


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text, none if it is null, and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def record_key(text: Column) -> Column:
    """Equal texts have equal keys; a null text has that of an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _unit(*cols: str) -> Column:
    """A number from 0 to 1 that the columns decide, other than the key itself."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit("draw")), 11) / F.lit(float(1 << 53))


def splitters(keyed: DataFrame, total: int, ranges: int, samples: int = SAMPLES) -> list[int]:
    """Boundaries of about `ranges` ranges of keys of equal bytes, from a size-weighted sample.

    A record is drawn with the chance size * ranges * samples / total, or for certain if
    that is over 1, and stands for total / (ranges * samples) bytes, or its own; so about
    ranges * samples records are drawn, however many there are. The key that a quantile
    falls on begins a range; if it spans a whole one, the key after it does so too.
    """
    step = total / (ranges * samples)
    drawn = keyed.where(_unit("key", "doc_id", "size") < F.col("size") / F.lit(step))
    found = drawn.groupBy("key").agg(F.sum(F.greatest("size", F.lit(step))).alias("bytes")).collect()  # about ranges * samples rows at most
    found.sort()
    whole = sum(r["bytes"] for r in found) / ranges
    out, before = set(), 0.0
    for key, own in found:
        first, last = int(before // whole), int((before + own) // whole)
        if last > first:
            out.add(key)
            if own >= whole and key < (1 << 63) - 1:
                out.add(key + 1)
        before += own
    return sorted(out)


def with_range(keyed: DataFrame, bounds: list[int]) -> DataFrame:
    """keyed with `range`: how many of the bounds are at most its key.

    Bounds go to the tasks by their leading bits, so a key is held against those few that share its own.
    """
    by_lead: dict[int, list[int]] = defaultdict(list)
    for b in bounds:
        by_lead[b >> (64 - LEAD)].append(b)
    rows, before = [], 0
    for lead in range(-(1 << (LEAD - 1)), 1 << (LEAD - 1)):
        rows.append((lead, before, by_lead[lead]))
        before += len(by_lead[lead])
    table = keyed.sparkSession.createDataFrame(rows, "lead long, first long, bounds array<long>")  # 2 ** LEAD rows
    told = keyed.withColumn("lead", F.shiftright("key", 64 - LEAD)).join(F.broadcast(table), "lead")
    below = F.size(F.filter("bounds", lambda b: b <= F.col("key")))
    return told.withColumn("range", F.col("first") + below).drop("lead", "first", "bounds")


def _piece(parts: Column, alone: Column) -> Column:
    """Which of a range's parts a record is in: told by id where the range is one text, else by key."""
    own = F.when(alone, F.xxhash64("doc_id", "key", F.lit("part"))).otherwise(F.xxhash64("key", F.lit("part")))
    return F.pmod(own, F.greatest(parts, F.lit(1)).cast("long"))


def deal(pieces: list[Row], shards: int) -> list[tuple[int, int, int, int]]:
    """(range, piece, shard, start) of (range, piece, alone, rows, bytes): largest first, each to the emptiest shard.

    The pieces of one text go together unless they outgrow a shard's share; others go one by one.
    """
    share = sum(p["bytes"] for p in pieces) / shards
    units: dict[tuple, list[Row]] = defaultdict(list)
    text = defaultdict(int)
    for p in pieces:
        text[p["range"]] += p["bytes"] if p["alone"] else 0
    for p in pieces:
        together = p["alone"] and text[p["range"]] <= share
        units[p["range"], -1 if together else p["piece"]].append(p)
    order = sorted(units.items(), key=lambda u: (-sum(p["bytes"] for p in u[1]), u[0]))
    emptiest = [(0, s) for s in range(shards)]
    slots, out = [0] * shards, []
    for _, own in order:
        held, shard = heapq.heappop(emptiest)
        for p in sorted(own, key=lambda p: p["piece"]):
            out.append((p["range"], p["piece"], shard, slots[shard]))
            slots[shard] += p["rows"]
        heapq.heappush(emptiest, (held + sum(p["bytes"] for p in own), shard))
    return out


def shard(docs: DataFrame, shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs, and the columns of keep.

    The law is `bytes`: sizes of the shards are as near as ranges of a 512th of a shard
    allow; grown_shard is null, as another number of shards deals anew. Null texts count
    as empty, and are together with empty ones. Rows that repeat an id and a text are in
    one piece, each with a slot of its own; null ids are ids like any other. Columns of
    docs that aren't kept are not read, and kept ones of the result's names are replaced;
    an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    ranges = RANGES * shards
    own = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [c for c in keep or [] if c not in own]
    text = F.col("text")
    names = [F.col(c).alias(f"k{i}") for i, c in enumerate(kept)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), record_key(text).alias("key"), *names)
    thin = stash(rows.select("doc_id", "size", "text_crc32", "key"), "record-keys")
    total = thin.agg(F.sum("size").alias("bytes")).first()["bytes"]
    if not total:
        return _told(rows.limit(0).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}), kept)
    bounds = splitters(thin, total, ranges)
    ranged = with_range(thin, bounds)
    full = total / ranges
    told = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("alone"))
    parts = F.when(F.col("bytes") > F.lit(1.5 * full), F.ceil(F.col("bytes") / F.lit(full))).otherwise(F.lit(1)).alias("parts")
    parts = stash(told.select("range", "alone", parts), "ranges")  # ranges * 2 rows at most: a text of its own has two bounds

    def pieced(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(parts), "range").withColumn("piece", _piece(F.col("parts"), F.col("alone"))).drop("parts")

    # parts sum up to ranges and the total by the size of one: five times ranges at most
    pieces = pieced(ranged).groupBy("range", "piece", "alone").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()
    dealt = docs.sparkSession.createDataFrame(deal(pieces, shards), "range long, piece long, shard int, start long")
    placed = pieced(with_range(rows, bounds) if kept else ranged).join(F.broadcast(dealt), ["range", "piece"])
    turn = F.row_number().over(Window.partitionBy("range", "piece").orderBy("key", "doc_id", "size"))
    return _told(placed.withColumn("slot", F.col("start") + turn - 1), kept)


def _told(placed: DataFrame, kept: list[str]) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write all columns of docs under path/shard=<n>/, each file in the order of slots.

    The rows of a piece are sorted as one, so a shard is many files of near equal size,
    written in parallel; a row keeps its slot as a column.
    """
    placed = shard(docs, shards, keep=docs.columns)
    placed.drop("law", "grown_shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
