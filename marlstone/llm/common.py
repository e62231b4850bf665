"""What the corpus operators share: table access, the shared folder, Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII white-space characters.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    A temporary folder stands in only where the setting is absent and the master is
    local, as in tests; elsewhere executors couldn't read what others wrote there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Where stash notes its tables: the innermost sweep of this thread, if it is within one.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


#: Rows for which a stash whose number of rows is known writes a file, and the files it writes at least.
FILE_ROWS, FILES = 50_000, 12


def stash(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    Where about how many rows there are at most is told, few rows are few files, as many
    small steps would else spend their time on opening and closing them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstone/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    if (noted := _noted.get()) is not None:
        noted.append(path)  # before it is written, so that a failed write is swept too
    if rows is not None:
        df = df.coalesce(max(FILES, rows // FILE_ROWS))
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes the tables that this thread's stash writes within, also after an error; gives a stash whose tables stay.

    Other threads' tables are their own. What is lazily defined within must be written
    within. Tables that stay within another sweep are that one's.
    """
    tables: list[str] = []
    kept: list[str] = []
    outer = _noted.get()
    token = _noted.set(tables)

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = stash(df, label)
        kept.append(tables[-1])
        return out

    try:
        yield keep
    finally:
        _noted.reset(token)
        if outer is not None:
            outer += kept
        for path in tables:
            if path not in kept:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; null ids belong to no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row; inside a lambda Spark computes an expression anew for each element."""
    return F.transform(F.array(value), body)[0]


#: Keys that join_hot broadcasts, at most.
HOT_KEYS = 5000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Equi-join of left with right, which has each key once; its `weight` column is how many rows of left have the key.

    Keys with more than 1 / HOT_KEYS of left's total rows are fewer than that, so they
    are broadcast; no hot key is shuffled. weight isn't in the result.
    """
    hot = F.col(weight) > F.lit(total / HOT_KEYS)
    hubs = right.where(hot).drop(weight).withColumn("is_hot", F.lit(True))
    told = left.join(F.broadcast(hubs), keys, "left")
    rest = told.where("is_hot is null").select(*left.columns).join(right.where(~hot).drop(weight), keys, how)
    return told.where("is_hot").drop("is_hot").unionByName(rest)


def join_salted(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner equi-join of left with right, which may have a key many times; its `weight` column is how many rows of left have the key.

    A key with more than 1 / HOT_KEYS of left's total rows is dealt in parts of about
    that many; right's rows of such a key go to each of its parts, left's by a hash of the row. Only the fewer than
    HOT_KEYS hot keys and their numbers of parts are broadcast. weight isn't in the result.
    """
    parts = F.ceil(F.col(weight) * F.lit(HOT_KEYS / max(total, 1))).cast("int")
    hubs = right.where(F.col(weight) > F.lit(total / HOT_KEYS)).select(key, parts.alias("parts")).distinct()
    told = left.join(F.broadcast(hubs), key, "left").withColumn("part", F.pmod(F.xxhash64(*left.columns), F.coalesce("parts", F.lit(1)).cast("long")).cast("int"))
    spread = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > F.lit(total / HOT_KEYS), parts - 1).otherwise(F.lit(0)))))
    return told.drop("parts").join(spread.drop(weight), [key, "part"]).drop("part")


#: What this worker process keeps from task to task. Workers outlive an operator's tasks.
_kept: dict[str, Any] = {}


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """make(), called once a worker process until let_go; what it keeps by another name goes."""
    if name not in _kept:
        let_go()
        _kept[name] = make()
    return _kept[name]


def let_go() -> None:
    """For tasks that need none of what their worker process keeps: gives its memory back."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = 512, text: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, of few rows and few bytes of text, so that few Python objects exist at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = int(np.clip(np.searchsorted(ends, before + size, "right") - at, 1, rows))
            yield batch.slice(at, n)
            at += n


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def labelled_sample(docs: DataFrame, marks: DataFrame, max_rows: int, max_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, label) of about max_rows labelled documents at most, chosen by a hash of the id.

    marks has one row a doc_id. With max_bytes, the sample has about that many bytes of
    text at most: texts go in parts of max_bytes / 16 characters, each a row, and parts
    are chosen by a hash of id and number. The chosen marks are bounded by max_rows, so
    they go to the documents and no text is shuffled.
    """
    share = min(1.0, max_rows / max(marks.count(), 1))
    buckets = F.lit(1 << 20)
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), buckets) < F.lit(int(share * (1 << 20))))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    if not max_bytes:
        return found
    there = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = max(1, max_bytes // 16)
    parts = found.select("doc_id", "text", "label", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / size)).cast("int"))).alias("part"))
    kept = F.pmod(F.xxhash64("doc_id", "part"), buckets) < F.lit(int(min(1.0, max_bytes / max(there, 1)) * (1 << 20)))
    return parts.where(kept).select("doc_id", F.substring("text", F.col("part") * size + 1, F.lit(size)).alias("text"), "label")
