"""Folded substring search by an inverted index of three-letter grams.

Every folded text is cut into its different grams; a posting says that a field of a row
has a gram. Texts are cut some thousand at a time, and the postings that these have of a
gram are one record, a list of keys; so what is shuffled and written is little more than
the keys. Postings lie in partitions by a hash of the gram, sorted by gram, rows in
partitions by a hash of their key. A search looks up how frequent the grams of its
pattern's literal runs are, intersects the postings of the rarest ones, fetches the rows
that are left and holds each against the whole pattern, wildcards included. So it gives
what a scan with LIKE gives, but reads the partitions of a few grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marlstone.functions import text as tx

GRAM = 3
#: Rows and bytes of text whose postings are put together, at most; characters of them that are cut at once.
SLICE_ROWS, SLICE_BYTES, PIECE = 4096, 4 << 20, 1 << 20


def _different(values: np.ndarray) -> np.ndarray:
    """The different values, sorted; np.unique takes twenty times as long for long arrays."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def grams(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different grams of texts that aren't null; how many texts have each; the numbers of these texts, gram by gram.

    A text that is shorter than a gram has none.
    """
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    letters = _different(points)
    code = np.zeros(int(letters[-1]) + 1 if len(letters) else 0, np.int64)
    code[letters] = np.arange(len(letters))
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(points), PIECE):
        coded = code[points[at : at + PIECE + GRAM - 1]]
        n = len(coded) - GRAM + 1
        if n <= 0:
            break
        gram = coded[:n].copy()
        for i in range(1, GRAM):
            gram *= len(letters)
            gram += coded[i : i + n]
        doc = np.searchsorted(ends, [at, at + n - 1], "right")
        own = np.arange(doc[0], doc[1] + 1)
        edges = np.clip(ends[own], at, at + n)
        doc = np.repeat(own, np.diff(np.r_[at, edges]))
        inside = np.arange(at, at + n) + GRAM <= ends[doc]
        found.append(_different(gram[inside] * len(texts) + doc[inside]))
    pairs = _different(np.concatenate(found)) if len(found) > 2 else found[-1]
    gram, doc = np.divmod(pairs, max(len(texts), 1))
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
    kinds = gram[starts]
    spelt = np.stack([letters[kinds // len(letters) ** i % len(letters)] for i in range(GRAM - 1, -1, -1)], axis=1) if len(kinds) else np.zeros((0, GRAM), "<u4")
    text = spelt.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + GRAM] for i in range(0, len(text), GRAM)], np.diff(np.r_[starts, len(doc)]), doc


def slices(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of at most SLICE_ROWS rows, and of SLICE_BYTES of their first columns' text if of several rows."""
    for batch in batches:
        ends = np.cumsum(sum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(fields)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            n = int(np.clip(np.searchsorted(ends, before + SLICE_BYTES, "right") - at, 1, SLICE_ROWS))
            yield batch.slice(at, n)
            at += n


def literal_runs(pattern: str) -> list[str]:
    """What a LIKE pattern has between wildcards; a character that is escaped ends a run, too."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_\\":
            runs.append("")
            at += c == "\\"
        else:
            runs[-1] += c
        at += 1
    return [r for r in runs if r]


def pattern_grams(pattern: str) -> list[str]:
    return list(dict.fromkeys(r[i : i + GRAM] for r in literal_runs(pattern) for i in range(len(r) - GRAM + 1)))


@dataclass(frozen=True)
class GramIndex:
    """An index under one path: rows/, postings/ and counts/. fields are columns of the rows; key is unique and not null."""

    spark: SparkSession
    path: str
    key: str
    fields: tuple[str, ...]
    schema: StructType
    gram_parts: int = 64
    row_parts: int = 64

    def _gram_part(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.gram_parts)).cast("int")

    def _row_part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.row_parts)).cast("int")

    def add(self, rows: DataFrame) -> None:
        """Index rows, whose keys the index doesn't have yet; null fields have no grams."""
        parted = rows.withColumn("row_part", self._row_part(F.col(self.key)))
        dealt = parted.repartition("row_part", self._share(F.xxhash64(F.col(self.key), F.lit(0)), self.row_parts))
        dealt.sortWithinPartitions("row_part", self.key).write.mode("append").partitionBy("row_part").parquet(f"{self.path}/rows")
        fields = len(self.fields)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, fields):
                for i in range(fields):
                    spelt, n, at = grams(part.column(i))
                    keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), part.column(fields).take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(np.full(len(n), i), pa.int32()), pa.array(spelt, pa.string())], ["keys", "n", "field", "gram"])

        folded = rows.select(*(tx.fold(F.col(f)).alias(f"f{i}") for i, f in enumerate(self.fields)), F.col(self.key).alias("key"))
        postings = folded.mapInArrow(cut, self._columns("postings")).withColumn("gram_part", self._gram_part(F.col("gram")))
        # a gram of most rows is dealt to several tasks
        dealt = postings.repartition("gram_part", self._share(F.xxhash64(F.element_at("keys", 1), F.lit(0)), self.gram_parts))
        dealt.sortWithinPartitions("gram_part", "gram", "field").write.mode("append").partitionBy("gram_part").parquet(f"{self.path}/postings")
        counts = self._table("postings").groupBy("gram_part", "gram", "field").agg(F.sum("n").alias("n"))
        counts.repartition("gram_part").sortWithinPartitions("gram_part", "gram").write.mode("overwrite").partitionBy("gram_part").parquet(f"{self.path}/counts")

    def _share(self, digest: Column, parts: int) -> Column:
        """Which of a partition's tasks a record goes to, so that all shuffle partitions have work, and eight at least."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return F.pmod(digest, F.lit(max(8, -(-tasks // parts))))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("row_part", IntegerType())])).parquet(f"{self.path}/rows")

    def _columns(self, name: str) -> str:
        key = self.schema[self.key].dataType.simpleString()
        return {"postings": f"keys array<{key}>, n long, field int, gram string", "counts": "gram string, field int, n long"}[name]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self._columns(name)}, gram_part int").parquet(f"{self.path}/{name}")

    def _of_grams(self, table: str, wanted: list[str]) -> DataFrame:
        """The rows of a table that have one of the grams; only their partitions are read."""
        parts = {r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string").select(self._gram_part(F.col("gram"))).collect()}
        return self._table(table).where(F.col("gram_part").isin(*parts) & F.col("gram").isin(*wanted))

    def rarest(self, wanted: list[str], most: int) -> dict[int, list[tuple[str, int]]]:
        """For each field that has all the grams, the `most` rarest ones and their counts, rarest first."""
        by_field: dict[int, list[tuple[int, str]]] = {i: [] for i in range(len(self.fields))}
        for r in self._of_grams("counts", wanted).select("field", "gram", "n").collect():  # fields times grams of the pattern
            by_field[r["field"]].append((r["n"], r["gram"]))
        return {f: [(g, n) for n, g in sorted(own)[:most]] for f, own in by_field.items() if len(own) == len(wanted)}

    def candidates(self, pattern: str, most: int = 4) -> DataFrame | None:
        """(key) of the rows of which a field has the pattern's rarest grams; None if the pattern has no gram."""
        folded = self.spark.range(1).select(tx.fold(F.lit(pattern))).first()[0]
        wanted = pattern_grams(folded)
        if not wanted:
            return None
        chosen = self.rarest(wanted, most)
        if not chosen:
            return self.spark.createDataFrame([], self.rows().select(F.col(self.key).alias("key")).schema)
        some = sorted({g for own in chosen.values() for g, _ in own})
        postings = self._of_grams("postings", some)
        fits = F.lit(False)
        for field, own in chosen.items():
            fits = fits | ((F.col("field") == field) & F.col("gram").isin(*(g for g, _ in own)))
        need = F.coalesce(*(F.when(F.col("field") == field, len(own)) for field, own in chosen.items()))
        held = postings.where(fits).select("field", F.explode("keys").alias("key")).groupBy("field", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == need)
        return held.select("key").distinct()

    def search(self, pattern: str, most: int = 4) -> DataFrame:
        """The rows of which a field contains the pattern, as any_contains_folded tells; % and _ are wildcards.

        A pattern without a literal run of three characters scans all rows.
        """
        rows, found = self.rows(), self.candidates(pattern, most)
        if found is None:
            return rows.where(tx.any_contains_folded([F.col(f) for f in self.fields], pattern)).drop("row_part")
        keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("found.n"))
        keys = keys.select("`found.n`", F.col("key").alias("found.key"), self._row_part(F.col("key")).alias("found.part"))
        fetched = rows.join(keys, (F.col("`found.key`") == F.col(self.key)) & (F.col("`found.part`") == F.col("row_part")))
        # a condition on the rows alone would be moved before the join, and fold the texts of all rows
        held = tx.any_contains_folded([F.when(F.col("`found.n`") > 0, F.col(f)) for f in self.fields], pattern)
        return fetched.where(held).select(*self.schema.names)


def build(rows: DataFrame, path: str, key: str, fields: list[str], gram_parts: int = 64, row_parts: int = 64) -> GramIndex:
    index = GramIndex(rows.sparkSession, path.rstrip("/"), key, tuple(fields), rows.schema, gram_parts, row_parts)
    index.add(rows)
    return index
