"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `min_match` tokens. A bitmap of bounded size, filled from the
benchmark's seeds, goes to every task and tells which runs of a document may be seeds;
these meet the benchmark's in an equi-join, which gives the candidate pairs. A pair
goes on only if enough item positions are seeds: tiles that cover c tokens hold at
least c / min_match of them. So the join can do without an item's commonest seeds, up to
less than that number, and loses no pair. Tiling then marks the longest non-overlapping matches
again and again, finding each by running Karp-Rabin hashes, on what the seeds of a
document cover (no tile reaches beyond that). Coverage counts item tokens, so
reordered passages are caught.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import join_hot, join_salted, stash, text_slices

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Sizes of the bitmap, as powers of two: 1 MB for small benchmarks, 64 MB at most; in between 16 bits a seed.
BITMAP_BITS = (23, 29)
#: Between two stretches of a document; no token has it.
GAP = np.uint64(0)
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: lower case, ASCII punctuation dropped."""
    words = (text or "").lower().encode().translate(_PUNCTUATION).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(toks: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of n tokens."""
    if len(toks) < n:
        return np.zeros(0, np.uint64)
    out = toks[: len(toks) - n + 1].copy()
    for i in range(1, n):
        out = out * BASE + toks[i : len(toks) - n + 1 + i]
    return out


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, tokens), longest first; tokens of either side are used once."""
    powers = np.ones(len(item) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(len(item)):
            powers[i + 1] = powers[i] * BASE

    def prefix(toks: np.ndarray) -> list[int]:
        h, out = 0, [0]
        for x in toks.tolist():
            h = (h * int(BASE) + x) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return out

    sums = [np.array(prefix(x), np.uint64) for x in (item, doc)]
    free = [np.ones(len(item), bool), doc != GAP]

    def open_windows(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for h, f in zip(sums, free):
            used = np.r_[0, np.cumsum(~f)]
            at = np.flatnonzero(used[n:] == used[:-n])
            out.append((at, h[at + n] - h[at] * powers[n]))
        return out

    def matched(n: int) -> bool:
        (_, a), (_, b) = open_windows(n)
        return bool(np.isin(a, b).any())

    tiles, low, high = [], min_match, min(len(item), len(doc))
    while high >= low and matched(low):
        lo, hi = low, high  # the longest match is in here
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if matched(mid) else (lo, mid - 1)
        (ai, ah), (bi, bh) = open_windows(lo)
        order = np.argsort(bh, kind="stable")
        marked = False
        for i, h in zip(ai[np.isin(ah, bh)], ah[np.isin(ah, bh)]):
            if not free[0][i : i + lo].all():
                continue
            for d in bi[order[np.searchsorted(bh[order], h) : np.searchsorted(bh[order], h, "right")]]:
                if free[1][d : d + lo].all() and (doc[d : d + lo] == item[i : i + lo]).all():
                    free[0][i : i + lo] = False
                    free[1][d : d + lo] = False
                    tiles.append((int(i), int(d), lo))
                    marked = True
                    break
        high = lo if marked else lo - 1
    return tiles


def _items(benchmark: DataFrame, min_match: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, tokens, seeds): a row for each distinct item with a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            toks = [tokens(t) for t in part.column("text").to_pylist()]
            seeds = [windows(t, min(min_match, len(t))) if len(t) else t for t in toks]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("item_id"), *(pa.array([x.view(np.int64) for x in xs], longs) for xs in (toks, seeds))], ["item_id", "tokens", "seeds"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    return rows.mapInArrow(run, "item_id long, tokens array<long>, seeds array<long>").where(F.size("tokens") > 0)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of a seed's leading bits: 2 ** bits of them."""
    bit = F.shiftrightunsigned("seed", 64 - bits) + 1
    filled = seeds.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in filled.collect():  # 4 KB each, 64 MB in all at most
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def bitmap_bits(seeds: int) -> int:
    """Bits of the bitmap's index for so many seeds."""
    least, most = BITMAP_BITS
    return max(least, min(most, (16 * seeds).bit_length()))


def _stretches(docs: DataFrame, bitmap, bits: int, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, seeds, tokens) of documents in which a seed may occur: its distinct seeds and the tokens they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, row = bitmap.value, TaskContext.get().partitionId() << 40
        shift = np.uint64(64 - bits)
        for part in text_slices(batches):
            out: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                row += 1
                toks = tokens(text)
                covered, seeds = np.zeros(len(toks) + 1, np.int32), []
                for n in lengths:
                    h = windows(toks, n)
                    at = h >> shift
                    hit = np.flatnonzero((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                    if len(hit):
                        covered[hit] += 1
                        covered[hit + n] -= 1
                        seeds.append(np.unique(h[hit]))
                if seeds:
                    inside = np.cumsum(covered[:-1]) > 0
                    keep = np.where(inside, toks, GAP)[inside | np.r_[False, inside[:-1]]]
                    out.append((row, doc, np.unique(np.concatenate(seeds)).view(np.int64), keep.view(np.int64)))
            if out:
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), longs, longs))], ["row", "doc_id", "seeds", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, seeds array<long>, tokens array<long>")


def _tiled(pairs: DataFrame, min_match: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            out = []
            for doc_id, item_id, doc, item in zip(cols["doc_id"], cols["item_id"], cols["tokens"], cols["item"]):
                a, b = (np.array(x, np.int64).view(np.uint64) for x in (doc, item))
                found = tile(a, b, min(min_match, len(b)))
                out.append((doc_id, item_id, len(b), sum(t[2] for t in found), len(found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "item_id", "item_tokens", "covered_tokens", "tiles"])

    return pairs.select("doc_id", "item_id", "tokens", "item").mapInArrow(run, "doc_id long, item_id long, item_tokens long, covered_tokens long, tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, tiles, coverage): a row for each document and item whose tokens it covers.

    Items of fewer tokens than min_match must occur whole. Null and blank texts match
    nothing. Equal items with one id count once; documents with null or repeated ids
    are each compared, and reported under the id they have. Empty tables give an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    items = stash(_items(benchmark, min_match, item_id_col, item_text_col), "items")
    seeds = items.select("item_id", F.xxhash64("item_id", "tokens").alias("item_key"), F.size("tokens").alias("n"), F.explode("seeds").alias("seed"))
    short = [r[0] for r in items.select(F.least(F.size("tokens"), F.lit(min_match))).distinct().collect()]  # at most min_match values
    bits = bitmap_bits(seeds.count())
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds, bits))
    found = stash(_stretches(docs, bitmap, bits, sorted(short), id_col, text_col), "stretches")
    places = seeds.groupBy("seed", "item_key", "n").agg(F.count(F.lit(1)).alias("places"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(coverage) / F.lit(min_match) - F.lit(1e-9)))
    # a pair has `least` places or more, so one at least beside the item's commonest seeds of less places in all
    in_docs = found.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("rows"))
    common = Window.partitionBy("item_key").orderBy(F.desc("rows"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    rare = places.join(in_docs, "seed").withColumn("so_far", F.sum("places").over(common)).where(F.col("so_far") >= least)
    rare = stash(rare.select("seed", "item_key", "rows"), "rare-seeds")
    met = found.select("row", F.explode("seeds").alias("seed"))
    n_met = found.agg(F.sum(F.size("seeds"))).first()[0] or 0
    candidates = stash(join_salted(met, rare, "seed", "rows", n_met).select("row", "item_key").distinct(), "candidates")
    texts = items.select(F.xxhash64("item_id", "tokens").alias("item_key"), "item_id", F.col("tokens").alias("item"), F.col("seeds").alias("item_seeds"), F.size("tokens").alias("n"))
    texts = texts.join(candidates.groupBy("item_key").agg(F.count(F.lit(1)).alias("pairs")), "item_key")
    pairs = join_hot(candidates.join(found, "row"), texts, ["item_key"], "pairs", candidates.count())
    repeats = F.size("item_seeds") - F.size(F.array_distinct("item_seeds"))
    pairs = pairs.where(F.size(F.array_intersect("item_seeds", "seeds")) + repeats >= least)
    return _tiled(pairs, min_match).withColumn("coverage", F.col("covered_tokens") / F.col("item_tokens")).where(F.col("coverage") >= coverage)
