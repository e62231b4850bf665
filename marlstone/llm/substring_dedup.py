"""Substring deduplication by hashing lines and the sentences in them.

A unit is a line, or each sentence of a line of several. Short ones (`min_words`) stay,
as documents that have nothing else in common share them. Units are normalised (case
and white space), their 128-bit digests grouped over the whole corpus, and all but the
earliest ranked occurrence removed. Offsets are those of the original text.

What repeats without regard to lines and sentences is found as passages: runs of a
given number of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import join_hot, stash, text_slices
from marlstone.llm.decontam import windows

#: A blank after one of these ends a unit, as a line break does.
SENTENCE_END = re.compile(r"([.!?]) ")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split_units(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised unit) in code points, end exclusive."""
    at = 0
    for unit in SENTENCE_END.sub("\\1\n", text).split("\n"):
        words = unit.lower().encode().split()
        if len(words) >= min_words:
            yield at, at + len(unit), b" ".join(words)
        at += len(unit) + 1


def units(docs: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, high, low): the long enough units of every row and the halves of their digests.

    Null and blank texts have none; units of a null id have a null id. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            ids, starts, ends, digests = [], [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for start, end, unit in split_units(text or "", min_words):
                    ids.append(doc)
                    starts.append(start)
                    ends.append(end)
                    digests.append(xxhash.xxh3_128_digest(unit))
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, starts, ends)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "start", "end", "high", "low"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, high long, low long")


def repeated_units(docs: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kept_doc_id, kept_start): a row for each unit to remove, and the occurrence that stays.

    The earliest occurrence is the one of the smallest doc_id, then of the smallest
    start. Units of fewer than min_words words always stay. Null and blank texts have
    no units. Rows with a null id are left alone. Rows that repeat an id and text give
    equal occurrences, which all stay if they are earliest. Empty tables give an empty
    result; other columns are not read.
    """
    found = stash(units(docs, min_words, id_col, text_col).where("doc_id is not null"), "units")
    first = found.groupBy("high", "low").agg(F.min(F.struct("doc_id", "start")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stash(first.select("high", "low", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), "n"), "first-units")
    return join_hot(found, first, ["high", "low"], "n", found.count()).where("doc_id <> kept_doc_id or start <> kept_start").select("doc_id", "start", "end", "kept_doc_id", "kept_start")


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_marks(hashes: np.ndarray, run_words: int) -> np.ndarray:
    """For every run of run_words words, the least hash of the runs of half as many in it: equal runs have equal marks, neighbours mostly the same."""
    short, n = windows(hashes, run_words - run_words // 2), run_words // 2 + 1
    if len(short) < n:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(short, n).min(axis=1).view(np.int64)


def _marked(docs: DataFrame, run_words: int) -> DataFrame:
    """(doc_id, start, end, high, low, marks) of the texts with a run: their first and last word, digest and distinct marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            ids, starts, ends, digests, marks = [], [], [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                hashes = word_hashes(text)
                if len(hashes) >= run_words:
                    ids.append(doc)
                    starts.append(WORD.search(text).start())
                    ends.append(len(text.rstrip(" \t\n\r\v\f")))
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    marks.append(np.unique(run_marks(hashes, run_words)))
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            columns = [*(pa.array(x, pa.int64()) for x in (ids, starts, ends)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "high", "low", "marks"])

    return docs.mapInArrow(run, "doc_id long, start long, end long, high long, low long, marks array<long>")


def _runs(docs: DataFrame, run_words: int) -> DataFrame:
    """(row, doc_id, at, start, end, high, low) of the runs with one of the row's marks, by their first word's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in text_slices(batches):
            for doc, text, marks in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "marks"))):
                hashes = word_hashes(text)
                at = np.flatnonzero(np.isin(run_marks(hashes, run_words), np.array(marks, np.int64)))
                spans = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
                whole = hashes.tobytes()
                digests = b"".join(xxhash.xxh3_128_digest(whole[8 * i : 8 * (i + run_words)]) for i in at.tolist())
                halves = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
                columns = [np.full(len(at), row), np.full(len(at), doc), at, spans[at, 0], spans[at + run_words - 1, 1], halves[:, 0], halves[:, 1]]
                row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["row", "doc_id", "at", "start", "end", "high", "low"])

    return docs.mapInArrow(run, "row long, doc_id long, at long, start long, end long, high long, low long")


def repeated_passages(docs: DataFrame, run_words: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kept_doc_id): the longest stretches made of runs of run_words words that a row of smaller id has too.

    Lines and sentences don't matter, and words are compared in lower case. Every such
    run is found. A stretch may come from several rows; kept_doc_id is the smallest of
    the earliest ids of its runs. What recurs only within one id stays. Of equal texts,
    only the one of the smallest id is searched and kept, and the others are stretches
    whole. A run is looked up only if its mark, a hash of a part of it, is in two ids.
    Null and short texts and null ids have no rows, and empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    marked = stash(_marked(rows, run_words), "marked")
    same = marked.groupBy("high", "low").agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = join_hot(marked.select("doc_id", "start", "end", "high", "low"), same, ["high", "low"], "n", marked.count()).where("doc_id > kept_doc_id").select("doc_id", "start", "end", "high", "low", "kept_doc_id")
    copies = stash(copies, "copies")
    single = marked.join(copies.select("doc_id", "high", "low").distinct(), ["doc_id", "high", "low"], "left_anti")
    marks = stash(single.select("doc_id", F.explode("marks").alias("mark")).distinct(), "marks")
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = join_hot(marks, shared, ["mark"], "n", marks.count()).groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    found = stash(_runs(rows.join(wanted, "doc_id"), run_words), "runs")
    first = found.groupBy("high", "low").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("kept_doc_id < last").drop("last")
    repeated = join_hot(found, stash(first, "first-runs"), ["high", "low"], "n", found.count()).where("doc_id > kept_doc_id")
    by_place = Window.partitionBy("row").orderBy("at")
    opens = F.coalesce(F.col("at") - F.lag("at").over(by_place) > run_words, F.lit(True))
    parts = repeated.withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("int")).over(by_place))
    stretches = parts.groupBy("row", "part").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept_doc_id").alias("kept_doc_id"))
    return stretches.select("doc_id", "start", "end", "kept_doc_id").unionByName(copies.select("doc_id", "start", "end", "kept_doc_id"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the units at these offsets, and without the breaks that ended them."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = max(at, end + 1)
    return "".join(out) + text[at:]
