"""Quality by compression: which labelled text does a document share its substrings with?

Zstandard dictionaries are trained on good and on bad labelled text. A document is
compressed with either, block by block, so that what it repeats of itself doesn't hide
what it shares with a dictionary. The difference of the two sizes, normalised by the
text's size and by the compressed sizes, is calibrated to a probability, by length, on
labelled rows that the dictionaries don't see. Fitting takes a bounded sample of
labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold_of, labelled_sample, text_slices, utf8

SAMPLE_CHUNK = 2048
#: Bytes that are compressed at once; every block of a text counts.
BLOCK = 1024
FEATURES = 5


@dataclass
class Sizes:
    """Compressors that are made on the worker, out of dictionaries that travel as bytes."""

    good: bytes
    bad: bytes
    level: int
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> tuple:
        return self.good, self.bad, self.level

    def __setstate__(self, state: tuple) -> None:
        self.good, self.bad, self.level = state
        self._made = []

    def features(self, texts: list[bytes]) -> np.ndarray:
        if not self._made:
            plain = zstandard.ZstdCompressor(level=self.level, write_content_size=False)
            for raw in (self.good, self.bad):
                words = zstandard.ZstdCompressionDict(raw) if raw else None
                if words:
                    words.precompute_compress(level=self.level)
                self._made.append(zstandard.ZstdCompressor(level=self.level, dict_data=words, write_content_size=False) if words else plain)
        good, bad = (np.array([sum(len(c.compress(t[i : i + BLOCK])) for i in range(0, max(1, len(t)), BLOCK)) for t in texts], float) for c in self._made)
        n = np.array([max(1, len(t)) for t in texts], float)
        by_text, by_size, length = (bad - good) / n, (bad - good) / (bad + good), np.log(n)
        return np.stack([by_text, by_size, length, by_text * length, by_size * length], axis=1)


@dataclass
class Model:
    sizes: Sizes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = (self.sizes.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -40, 40)))


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the text is too little to train on, the text itself as its content."""
    chunks = [t[i : i + SAMPLE_CHUNK] for t in texts for i in range(0, len(t), SAMPLE_CHUNK)]
    try:
        return zstandard.train_dictionary(size, chunks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(chunks)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: DataFrame, dictionary_size: int = 32 << 10, level: int = 3) -> Model:
    """Learn from a bounded sample of (doc_id, text, label), which is gathered.

    Half of it makes the dictionaries, the other half calibrates.
    """
    rows = rows.where("label is not null and text is not null")
    found = rows.select(F.xxhash64(F.col("doc_id"), F.lit(1)).alias("order"), "text", "label").collect()
    found.sort(key=lambda r: (r["order"], r["text"]))
    seen, rest = found[::2], found[1::2] or found
    sizes = Sizes(*(dictionary([r["text"].encode() for r in seen if r["label"] == label], dictionary_size) for label in (1, 0)), level)
    y = np.array([r["label"] for r in rest], float)
    x = sizes.features([r["text"].encode() for r in rest])
    if not len(y) or y.min() == y.max():
        prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return Model(sizes, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(FEATURES), prior])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    return Model(sizes, centre, scale, logistic((x - centre) / scale, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.scores(utf8(part, "text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, max_rows: int = 8000, max_bytes: int = 24 << 20) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; the score is the probability of label 1.

    Labels of the held-out fold are never read. Labels that are null or lack a document
    teach nothing; of several labels of one document the higher counts. Null and empty
    texts are scored as empty; rows with a null id are scored and belong to no fold;
    repeated rows are each scored. Without labels of both kinds every score is the
    share of label 1. Empty tables give an empty result.
    """
    fold = fold_of(F.col("doc_id"), folds)
    marks = labels.where((fold != held_out) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    model = fit(labelled_sample(docs, marks, max_rows, max_bytes))
    held = F.coalesce(fold == held_out, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
