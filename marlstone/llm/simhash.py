"""SimHash near-duplicate groups, with pivot distance tables as the pair filter.

Fingerprints within a few bits of each other are found exactly. Candidate pairs
share an equal bit block combination (with d differing bits and d+3 blocks, three
blocks at least are untouched). Pivot distances alone can't form such buckets:
among 64-bit fingerprints one pivot coordinate within 4 bits keeps more than half
of all random pairs. Inside a bucket a table of Hamming distances to reference
fingerprints is computed once; by the triangle inequality a pair whose largest
coordinate difference exceeds d can't be within d bits and is discarded; what
survives is verified on the fingerprints themselves.

At wider distances so many combinations would be needed that few bits were left in each.
There a block alone makes the buckets, with at most two differing bits: of d bits that fall
into d/3 blocks, some block has two or fewer. A fingerprint goes to the bucket of the block
and to those of the block with any one bit flipped, so two that are two bits apart meet.
A second fingerprint, of other features, confirms a pair, so that chance doesn't link texts
of one language however large the corpus is.

Only distinct fingerprints meet in buckets: exact copies are collapsed first by a
grouped minimum. A bucket emits a spanning forest of its links, not its pairs. A bucket
that outgrows BUCKET_ROWS isn't held: it is put off and dealt out in pairs of blocks,
each small enough, which together compare all its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import join_hot, stash, text_slices, utf8
from marlstone.llm.components import connected_components

BITS = 64
SEED = 42
SHINGLE_BLOCK = 1 << 16
#: Fingerprints of a bucket that one task takes at once.
BUCKET_ROWS = 1 << 16
#: Buckets up to this size are compared many at a time, row against row; larger ones each by itself.
TOGETHER = 2048


def fingerprint(text: bytes, shingle_words: int = 4, distinct: bool = False) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text's shingles, repeats included or not; zero if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    last = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(BITS, np.int64)

    def grams(part: list[bytes]) -> Iterator[bytes]:
        return map(join, zip(*(part[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else iter([join(words)])

    if distinct:
        kinds = list(set(grams(words)))
        parts, last = (kinds[at : at + SHINGLE_BLOCK] for at in range(0, len(kinds), SHINGLE_BLOCK)), len(kinds)
    else:
        parts = (grams(words[at : min(at + SHINGLE_BLOCK, last) + shingle_words - 1]) for at in range(0, last, SHINGLE_BLOCK))
    for part in parts:
        hashes = np.array([digest(g, SEED) for g in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False, confirm_words: int | None = None) -> DataFrame:
    """(doc_id, fp, fp2): one row per row of docs, as signed longs; fp2 is that of confirm_words, or zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = utf8(part, "text")
            fps = [np.array([fingerprint(t, k, distinct) if k else 0 for t in texts], np.uint64).view(np.int64) for k in (shingle_words, confirm_words)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, fps)], ["doc_id", "fp", "fp2"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, fp2 long")


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2 ..., so the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(count)], np.uint64)


def block_masks(distance: int, kept: int = 3) -> list[int]:
    """Masks of every choice of kept blocks out of distance + kept, as signed longs."""
    n = distance + kept
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [reduce(int.__or__, chosen) for chosen in combinations(blocks, kept)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def flip_masks(distance: int) -> tuple[list[int], list[list[int]]]:
    """Masks of so few blocks that one has two differing bits at most, and for each its bits, all as signed longs."""
    n = (distance + 3) // 3
    edges = [BITS * i // n for i in range(n + 1)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:])], [[signed(1 << i) for i in range(a, b)] for a, b in zip(edges, edges[1:])]


def _near(x: int, y: int, coords: np.ndarray, fps: np.ndarray, seconds: np.ndarray, table: np.ndarray, distance: int, confirm: int) -> np.ndarray:
    """Indices of the fingerprints near to x and, by the second ones, to y; coords are the pivot distances of x."""
    left = np.arange(len(fps))
    for c in range(table.shape[1]):
        left = left[np.abs(table[left, c] - coords[c]) <= distance]
        if not len(left):
            return left
    left = left[np.bitwise_count(fps[left] ^ x) <= distance]
    return left[np.bitwise_count(seconds[left] ^ y) <= confirm]


def forest(fps: np.ndarray, seconds: np.ndarray, table: np.ndarray, distance: int, confirm: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within the bucket, one less than members of each component.

    A breadth-first search over the members not yet reached, which shrink fast where
    a bucket is dense.
    """
    links, rest = [], np.arange(len(fps))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            hit = _near(fps[x], seconds[x], table[x], fps[rest], seconds[rest], table[rest], distance, confirm)
            if len(hit):
                found = rest[hit]
                links += [(int(x), int(y)) for y in found]
                frontier += list(found)
                rest = np.delete(rest, hit)
    return links


def _links(choice: np.ndarray, key: np.ndarray, fp: np.ndarray, fp2: np.ndarray, node: np.ndarray, distance: int, confirm: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, whose rows stand together."""
    starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
    sizes = np.diff(np.r_[starts, len(key)])
    shared = np.repeat(sizes > 1, sizes)
    fp, fp2, node, sizes = fp[shared], fp2[shared], node[shared], sizes[sizes > 1]
    starts = np.cumsum(sizes) - sizes
    table = np.stack([np.bitwise_count(fp ^ p).astype(np.int8) for p in refs], axis=1)
    two = starts[sizes == 2]
    for c in range(len(refs)):
        two = two[np.abs(table[two, c] - table[two + 1, c]) <= distance]
    two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
    two = two[np.bitwise_count(fp2[two] ^ fp2[two + 1]) <= confirm]
    a, b = [node[two]], [node[two + 1]]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        if pairs := forest(fp[s : s + n], fp2[s : s + n], table[s : s + n], distance, confirm):
            x, y = np.array(pairs).T
            a.append(node[s + x])
            b.append(node[s + y])
    return np.concatenate(a), np.concatenate(b)


def _here(choice: np.ndarray, key: np.ndarray, x: np.ndarray, y: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether x and y, which meet in a bucket of flip_masks, are to be linked in this one of all in which they meet."""
    apart = x ^ y
    there = np.ones(len(x), bool)
    for i, m in enumerate(masks[:-1]):
        there &= (choice <= i) | (np.bitwise_count(apart & m) > 2)
    m = masks[choice]
    low = apart & m
    low &= ~low + np.uint64(1)  # a pair two bits apart meets where either has the other's lower bit, or its higher one
    return there & (key == np.minimum((x & m) ^ low, (y & m) ^ low))


def _links_together(choice: np.ndarray, key: np.ndarray, fp: np.ndarray, fp2: np.ndarray, node: np.ndarray, distance: int, confirm: int, refs: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _links, for buckets of flip_masks; of those up to TOGETHER rows, a pair is linked in one of the buckets in which it meets.

    Every row is held against the next one of its bucket, the next but one and so on; all
    buckets, the largest first, take such a step at once. One with as many links as rows
    gives their forest.
    """
    starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
    sizes = np.diff(np.r_[starts, len(key)])
    order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > 1)]
    starts, sizes = starts[order], sizes[order]
    large = np.count_nonzero(sizes > TOGETHER)
    ends = np.cumsum(sizes)
    rows = np.repeat(starts - (ends - sizes), sizes) + np.arange(sizes.sum())
    choice, key, fp, fp2, node = choice[rows], key[rows].view(np.uint64), fp[rows], fp2[rows], node[rows]
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    table = np.stack([np.bitwise_count(fp ^ p).astype(np.int8) for p in refs])
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = ends[large - 1] if large else 0
    for step in range(1, sizes[large] if large < len(sizes) else 1):
        last = ends[np.count_nonzero(sizes > step) - 1]
        near = bucket[first : last - step] == bucket[first + step : last]
        for coords in table:
            near &= np.abs(coords[first : last - step] - coords[first + step : last]) <= distance
        at = first + np.flatnonzero(near)
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        at = at[np.bitwise_count(fp2[at] ^ fp2[at + step]) <= confirm]
        at = at[_here(choice[at], key[at], fp[at], fp[at + step], masks)]
        x.append(at)
        y.append(at + step)
    x, y = np.concatenate(x), np.concatenate(y)
    dense = np.bincount(bucket[x], minlength=len(sizes)) >= sizes
    dense[:large] = True
    few = ~dense[bucket[x]]
    a, b = [node[x[few]]], [node[y[few]]]
    for s, n in zip((ends - sizes)[dense], sizes[dense]):
        if pairs := forest(fp[s : s + n], fp2[s : s + n], table[:, s : s + n].T, distance, confirm):
            left, right = np.array(pairs).T
            a.append(node[s + left])
            b.append(node[s + right])
    return np.concatenate(a), np.concatenate(b)


def _solve_buckets(batches: Iterator[pa.RecordBatch], distance: int, confirm: int, refs: np.ndarray, limit: int | None, masks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket may span batches. One of more than limit rows gives its key and size instead of links."""

    def linked(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*held)]
        a, b = _links(*cols, distance, confirm, refs) if masks is None else _links_together(*cols, distance, confirm, refs, masks)
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none], ["a", "b", "choice", "key", "size"])

    def put_off(choice: int, key: int, size: int) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *(pa.array([int(x)], pa.int64()) for x in (choice, key, size))], ["a", "b", "choice", "key", "size"])

    held: list[list[np.ndarray]] = []  # of the open bucket
    size, now = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("choice", "key", "fp", "fp2", "node")]
        cols[2:4] = [c.view(np.uint64) for c in cols[2:4]]
        edges = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]), True])
        first = (cols[0][0], cols[1][0])
        done, at = [], 0
        if now is not None:
            if now == first:
                at = int(edges[1])
                size += at
                held = [*held, [c[:at] for c in cols]] if limit is None or size <= limit else []
            if now != first or at < batch.num_rows:  # the open bucket has ended
                if held:
                    done += held
                else:
                    yield put_off(*now, size)
        if at < batch.num_rows:
            last = int(edges[-2])
            if last > at:
                done.append([c[at:last] for c in cols])
            now, held, size = (cols[0][-1], cols[1][-1]), [[c[last:] for c in cols]], batch.num_rows - last
        if done:
            yield linked(done)
    if held:
        yield linked(held)
    elif now is not None:
        yield put_off(*now, size)


def fingerprint_links(reps: DataFrame, distance: int = 4, n_pivots: int = 16, bucket_rows: int = BUCKET_ROWS, confirm: int = BITS, flips: bool = False) -> DataFrame:
    """Links (a, b) between node ids whose fingerprints differ in at most distance bits.

    reps has distinct fp and their node, and fp2 where a link needs second fingerprints
    within `confirm` bits too. All such links are in a bucket and each bucket gives a
    spanning forest of its links, or those that no other one gives; so together they
    connect what all links connect. Buckets are combinations of three blocks, or with
    `flips` blocks with a bit flipped, which suits wide distances. fp and node are never
    null; no rows give no links.
    """
    refs = pivots(n_pivots)
    schema = "a long, b long, choice long, key long, size long"
    if "fp2" not in reps.columns:
        reps = reps.withColumn("fp2", F.lit(0).cast("long"))
    if flips:
        blocks, bits = flip_masks(distance)
        masks = np.array(blocks, np.int64).view(np.uint64)
        keys = [(i, F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(bit))) for i, m in enumerate(blocks) for bit in [0, *bits[i]]]
    else:
        masks = None
        keys = [(i, F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(distance))]
    choices = F.array(*(F.struct(F.lit(i).cast("long").alias("choice"), key.cast("long").alias("key")) for i, key in keys))
    keyed = reps.select("fp", "fp2", "node", F.explode(choices).alias("k")).select("k.choice", "k.key", "fp", "fp2", "node")
    dealt = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key")
    solved = stash(dealt.mapInArrow(lambda it: _solve_buckets(it, distance, confirm, refs, bucket_rows, masks), schema), "simhash-links")
    links = solved.where("a is not null").select("a", "b")
    large = solved.where("a is null").select("choice", "key", "size")
    if not large.isEmpty():
        parts = F.ceil(F.col("size") / bucket_rows)
        own = F.pmod(F.xxhash64("fp", "fp2"), parts)
        rows = keyed.join(large, ["choice", "key"]).select("choice", "key", "fp", "fp2", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select("choice", pair.alias("key"), "fp", "fp2", "node").repartition("choice", "key").sortWithinPartitions("choice", "key")
        links = links.unionByName(rows.mapInArrow(lambda it: _solve_buckets(it, distance, confirm, refs, None), schema).select("a", "b"))
    return links.distinct()


def _grouped(signed: DataFrame, **how: int) -> DataFrame:
    """(doc_id, fp, fp2, component_id) of fingerprints; equal ones count as one, of which no hot one is shuffled."""
    reps = stash(signed.groupBy("fp", "fp2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    groups = connected_components(fingerprint_links(reps.where("node is not null").select("fp", "fp2", "node"), **how))
    named = stash(reps.join(groups, "node", "left").select("fp", "fp2", F.coalesce("component", "node").alias("component_id"), "n"), "simhash-groups")
    return join_hot(signed, named, ["fp", "fp2"], "n", signed.count())


def near_duplicate_groups(docs: DataFrame, shingle_words: int = 4, distance: int = 4, n_pivots: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for every row of docs.

    component_id is the smallest id reachable over links, the own one included.
    Null and blank texts have fingerprint zero and link like any other. A row with a
    null id shares the component of equal fingerprints but takes no part in further
    linking. Rows that repeat an id stay as many rows; they count as one document. An
    empty table gives an empty result; other columns of docs are not read.
    """
    signed = stash(fingerprints(docs, shingle_words, id_col, text_col), "simhash")
    found = _grouped(signed, distance=distance, n_pivots=n_pivots)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, distance: int = 8, confirm: int = 12, n_pivots: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row of docs, for texts that are edited copies of each other.

    Texts link if the fingerprints of their distinct words differ in at most distance
    bits and those of their distinct word pairs in at most confirm. Copies that share
    0.8 of their five-word shingles differ in up to 8 and 10 bits. All such links are
    found. Odd rows are as in near_duplicate_groups.
    """
    signed = stash(fingerprints(docs, 1, id_col, text_col, distinct=True, confirm_words=2), "simhash")
    return _grouped(signed, distance=distance, n_pivots=n_pivots, confirm=confirm, flips=True).select("doc_id", "component_id")
