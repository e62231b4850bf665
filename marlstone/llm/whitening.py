"""Whitening of embeddings by hierarchical SVD merging.

Entries are fixed-point integers, so counts, sums and deviations are exact whatever the
order of rows. The fit list holds each distinct vector once. A part of it keeps its
number of vectors, their sums (so their mean) and all singular values and right singular
vectors of its centred rows. Two such parts merge by putting their scaled vectors under
each other with one more row that corrects for the difference of their means, and taking
the SVD of that; no dimension is dropped, so the result is that of all rows at once. Parts are
merged in groups of a fixed number, level by level, until one is left. Centring is done
on exact differences, so a mean far larger than the spread costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import stash

SCALE = 64
OFFSET = 1_000_000
#: Entries beyond this have no fixed-point form.
LARGEST = float(1 << 62)
#: Vectors that are decomposed at a time.
BLOCK = 512
#: Parts that are merged at a time.
FAN_IN = 8
#: Components whose singular value is less than the first's by this carry no spread but rounding.
FLAT = 1e-11
_LONG = (1 << 63) - 1


@dataclass
class Part:
    """What some vectors leave: their number, exact sums, and their centred rows' singular values and vectors."""

    n: int
    sums: np.ndarray  # Python integers
    values: np.ndarray
    vectors: np.ndarray  # a row a value

    @property
    def pivot(self) -> np.ndarray:
        return self.sums // self.n

    def mean_over(self, pivot: np.ndarray) -> np.ndarray:
        """The mean less an integer pivot, rounded once."""
        return np.array([int(s - self.n * p) / self.n for s, p in zip(self.sums, pivot)])


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def part_of(x: np.ndarray) -> Part:
    """A part of the rows of an integer matrix."""
    pivot = x[0]
    off = x - pivot  # exact
    sums = np.array([int(p) * len(x) + s for p, s in zip(pivot, off.sum(0, dtype=object) if np.abs(off).max() > 1 << 50 else off.sum(0).astype(object))], object)
    part = Part(len(x), sums, np.zeros(0), np.zeros((0, x.shape[1])))
    part.values, part.vectors = _decomposed(off.astype(float) - part.mean_over(pivot.astype(object)))
    return part


def merged(a: Part, b: Part) -> Part:
    """The part of both's vectors."""
    n = a.n + b.n
    shift = a.mean_over(a.pivot) - b.mean_over(a.pivot)
    correction = np.sqrt(a.n * b.n / n) * shift
    return Part(n, a.sums + b.sums, *_decomposed(np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, correction[None]])))


def fixed_points(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of every row of (vec_id, embedding) whose vector has entries, all finite: x as 64-bit integers, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = column.flatten()  # of null vectors nothing
            values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes)
            good = np.abs(values) * SCALE < LARGEST
            bad = np.r_[0, np.cumsum(~good)]
            keep = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
            x = (np.floor(SCALE * np.where(good, values, 0)).astype("<i8") + OFFSET).tobytes()
            packed = [x[8 * (ends[i] - sizes[i]) : 8 * ends[i]] for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), pa.array(packed, pa.binary())], ["vec_id", "x"])

    return rows.mapInArrow(run, "vec_id long, x binary")


def _matrices(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of some rows, and their vectors as an integer matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            x = np.frombuffer(b"".join(part.column(column).to_pylist()), "<i8").reshape(part.num_rows, -1)
            yield part, x


_PART = "node long, n long, sums array<string>, singular_values array<double>, vectors array<double>"


def _row(node: int, p: Part) -> dict:
    return {"node": node, "n": p.n, "sums": [str(s) for s in p.sums], "singular_values": p.values.tolist(), "vectors": p.vectors.ravel().tolist()}


def _part(row) -> Part:
    d = len(row["sums"])
    values = np.array(row["singular_values"], float)
    return Part(int(row["n"]), np.array([int(s) for s in row["sums"]], object), values, np.array(row["vectors"], float).reshape(len(values), d))


def decomposition(fit: DataFrame) -> Part | None:
    """The part of all rows of (x): a part a task, merged FAN_IN at a time. None for no rows.

    A part is of the size of the vectors' dimension squared, whatever the number of rows;
    one part goes to the driver.
    """

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for _, x in _matrices(batches, "x", BLOCK):
            own = part_of(x) if own is None else merged(own, part_of(x))
        if own is not None:
            yield pa.RecordBatch.from_pylist([_row(TaskContext.get().partitionId(), own)], schema=_ARROW)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_part(r) for _, r in rows.sort_values("node").iterrows()]
        own = parts[0]
        for p in parts[1:]:
            own = merged(own, p)
        return pd.DataFrame([_row(int(key[0]), own)])

    level = stash(fit.mapInArrow(leaves, _PART), "svd-parts")
    while (n := level.count()) > 1:
        # nodes are numbered anew, so that groups are full even where tasks had no rows
        numbers = [(r["node"], i // FAN_IN) for i, r in enumerate(level.select("node").orderBy("node").collect())]  # one a part
        into = level.sparkSession.createDataFrame(numbers, "node long, parent long")
        level = stash(level.join(F.broadcast(into), "node").groupBy("parent").applyInPandas(merge, _PART), "svd-parts")
    return _part(level.first()) if n else None


_ARROW = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("singular_values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


@dataclass
class Whitener:
    n: int
    sums: np.ndarray  # Python integers
    components: np.ndarray  # a unit vector a row
    eigenvalues: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """n * x - S, and the sum of its squares over the dimensions, exact; None beyond a long."""
        widest = max(int(np.abs(x).max(initial=0)), 1)
        if widest * self.n < 1 << 61 and max(map(abs, self.sums)) < 1 << 61:
            off = x * self.n - self.sums.astype(np.int64)
            most = int(np.abs(off).max(initial=0))
            if most * most * x.shape[1] <= _LONG:
                return off.astype(float), (off * off).sum(1).tolist()
        else:
            off = x.astype(object) * self.n - self.sums
        squares = [sum(int(v) ** 2 for v in row) for row in off]
        return off.astype(float), [s if s <= _LONG else None for s in squares]

    def project(self, off: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of n * x - S."""
        return (off / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


def whitener(fit: DataFrame, components: int) -> Whitener | None:
    """None without a direction that has spread."""
    whole = decomposition(fit)
    if whole is None or not whole.values[0] > 0:
        return None
    e = whole.values**2 / whole.n
    k = min(components, int((whole.values > FLAT * whole.values[0]).sum()))
    vectors = whole.vectors[:k] / np.linalg.norm(whole.vectors[:k], axis=1, keepdims=True)
    vectors *= np.sign(vectors[np.arange(k), np.abs(vectors).argmax(1)])[:, None]  # the largest entry is positive
    return Whitener(whole.n, whole.sums, vectors, e[:k], e[:k] / e.sum())


def identity_error(fit: DataFrame, w: Whitener) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(w.eigenvalues)
    shared = fit.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, met = shared.value, np.zeros((k + 1, k)), False
        for _, x in _matrices(batches, "x", BLOCK):
            z = w.project(w.deviations(x)[0])
            total += np.vstack([z.T @ z, z.sum(0)])
            met = True
        if met:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    sums = np.zeros((k + 1, k))
    for r in fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # components squared
        sums[r["i"], r["j"]] = r["v"]
    mean = sums[k] / w.n
    return float(np.abs(sums[:k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null, empty, or hold a null, a NaN, an infinity or an entry too
    large for its fixed-point form are left out, as are those of another dimension than
    most distinct ones have (of as many, the larger). Repeated vectors count once in the
    fit and each get their rows; null ids are passed on. Components without spread don't
    exist, so there may be fewer than asked for, and none for equal vectors. deviation
    is null beyond a long. An empty table gives an empty result; other columns aren't read.
    """
    spark = vectors.sparkSession
    points = fixed_points(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")))
    distinct = stash(points.select("x").distinct(), "distinct-vectors")
    lengths = distinct.groupBy(F.octet_length("x").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("bytes")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    same = F.octet_length("x") == F.lit(usual["bytes"] if usual else 0)
    fit = distinct.where(same)
    found = whitener(fit, components)
    if found is None:
        return spark.createDataFrame([], schema)
    error = identity_error(fit, found)
    shared = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = len(w.eigenvalues)
        for part, x in _matrices(batches, "x", 2048):
            off, deviations = w.deviations(x)
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            deviation = pa.array(deviations, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
            number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
            whole = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [ids, number, pa.array(np.full(whole, w.n)), deviation, pa.array(w.project(off).ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(whole, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.where(same).mapInArrow(run, schema)
