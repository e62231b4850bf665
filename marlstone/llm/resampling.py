"""Target-distribution importance resampling.

Features of a text are its words, hashed into buckets. How much likelier a bucket is in
the target than in the corpus is one array of integer gains, which goes to every task
and scores all texts. Each document's score is its mean gain and a Gumbel noise that its
id alone decides, so the highest scores are a sample without replacement in proportion
to the exponential of the weights. The k-th highest score is found by radix selection:
the keys (falling score, rising id) are counted digit by digit, each time among those
that share the digits found so far, until the exact k-th key is known. Only what lies up
to it is sorted, by ranges, and ranked by its place in its range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import stash, text_slices, utf8

#: Digits, lower-case letters and bytes of other characters make words; A-Z are lowered first.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
#: Words whose bucket a task remembers.
_MEMORY = 1 << 20
#: Bits of a digit of the radix selection: counts of so many values go to the driver at a time.
DIGIT = 14


class Buckets(dict):
    """Buckets of words by their crc32, remembered for the next time."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        self[word] = at = zlib.crc32(word) % self.size
        return at

    def of(self, text: bytes, longest: int) -> tuple[int, np.ndarray]:
        """The number of words, and the buckets of all runs of 1 to `longest` consecutive ones."""
        words = [w for w in text.translate(_WORD_BYTES).split(b" ") if w]
        runs = words if longest == 1 else [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all rows of (text) each bucket has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for part in text_slices(batches):
            for text in utf8(part, "text"):
                total += np.bincount(known.of(text, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier a bucket is in the target, floored; counts are smoothed by one."""
    n, s, t = float(len(corpus)), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of (doc_id, text); weight is the floored mean gain."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        known = Buckets(len(gain))
        for part in text_slices(batches):
            found = [known.of(text, longest) for text in utf8(part, "text")]
            words = np.array([w for w, _ in found], np.int64)
            n = np.array([len(x) for _, x in found], np.int64)
            sums = np.array([int(gain[x].sum()) for _, x in found], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(n), pa.array(sums // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousandfold standard Gumbel noise, floored, that seed and id decide; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def kth_key(rows: DataFrame, keys: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th smallest of the rows' (keys), all long, by radix selection; None where there are fewer.

    Each round counts one digit of one key among the rows that agree with all digits
    found so far, so the driver gets 2 ** DIGIT counts at most a round, and no row is moved.
    """
    spans = rows.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{o}{i}") for i, c in enumerate(keys) for f, o in ((F.min, "lo"), (F.max, "hi")))).first()
    if not 0 < k <= spans["n"]:
        return None
    found: list[int] = []
    for i, key in enumerate(keys):
        low, bits = spans[f"lo{i}"], max(1, (spans[f"hi{i}"] - spans[f"lo{i}"]).bit_length())
        if bits > 63:
            low, bits = 0, 64
            value = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
        else:
            value = F.col(key) - F.lit(low)
        prefix, left = 0, bits
        while left:
            width = min(DIGIT, left)
            left -= width
            digit = F.shiftrightunsigned(value, left).bitwiseAND(F.lit((1 << width) - 1))
            counts = dict(rows.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect())
            for at in sorted(counts):
                if k <= counts[at]:
                    break
                k -= counts[at]
            prefix = prefix << width | at
            rows = rows.where(digit == at)
        found.append(prefix - (1 << 63) if bits == 64 else prefix + low)
    return tuple(found)


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their rank by keys, from 1: sorted by ranges, each row's place counted on from the ranges before."""
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()  # the partition, and from bit 33 down the place in it
    told = stash(ranges.withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = sorted(told.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = np.r_[0, np.cumsum([r["n"] for r in sizes])]
    starts = rows.sparkSession.createDataFrame([(int(r["part"]), int(b)) for r, b in zip(sizes, before)], "part long, start long")
    return told.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at") + 1).drop("part", "at", "start")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, of every row of docs; rank is null for what isn't drawn.

    percent of the documents of min_words words or more are drawn: the highest scores,
    of equal ones the smaller id. Null and blank texts have no feature and weight 0. Rows
    with a null id have no noise, so no score, and are never drawn nor counted; rows that
    repeat an id are drawn one by one, equal keys in any order. An empty target leaves
    gains that only level the corpus; an empty docs gives an empty result. Other columns
    are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(texts, buckets, longest), bucket_counts(target, buckets, longest))
    scored = stash(weigh(texts, gain, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    enough = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    able = scored.where(enough).select("*", (-F.col("score")).alias("falling"))
    n = percent * able.count() // 100
    last = kth_key(able, ["falling", "doc_id"], n)
    undrawn = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, undrawn)
    falling, doc_id = -F.col("score"), F.col("doc_id")
    drawn = (falling < last[0]) | ((falling == last[0]) & (doc_id <= last[1]))
    chosen = F.coalesce(enough & drawn, F.lit(False))
    rank = F.when(F.col("rank") <= n, F.col("rank")).alias("rank")  # rows that share the last key may be more than are due
    top = ranked(able.where(drawn), ["falling", "doc_id"]).select(*columns, rank)
    return scored.where(~chosen).select(*columns, undrawn).unionByName(top)
