"""Tables whose changes are all-or-nothing: staged files and a log of versions.

A change writes its files first, where nobody looks. Then one manifest, which names all
files of the new version, is put in place by a create that fails if the version is there
already. So a failure in between leaves the last version as it was, of two writers that
began at one version one wins, and a reader that is bound to a version reads the same
rows for as long as its files are kept.

Rows lie in buckets by a hash of their key, and a manifest has the files of each bucket;
a change of some keys rewrites their buckets and takes the others over.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators import paging

BUCKET = "__bucket"


class Conflict(Exception):
    """Another change has made the version that this one was to be."""


@dataclass(frozen=True)
class Version:
    number: int
    operation: str
    schema: StructType
    keys: tuple[str, ...]
    files: dict[int, tuple[str, ...]]  # by bucket

    def to_json(self) -> str:
        body = {"number": self.number, "operation": self.operation, "schema": self.schema.jsonValue(), "keys": list(self.keys), "files": {str(b): list(f) for b, f in sorted(self.files.items())}}
        return json.dumps(body)

    @staticmethod
    def of_json(text: str) -> Version:
        x = json.loads(text)
        return Version(x["number"], x["operation"], StructType.fromJson(x["schema"]), tuple(x["keys"]), {int(b): tuple(f) for b, f in x["files"].items()})


class VersionedTable:
    """A table under one path: data/<change>/__bucket=<n>/ for files, log/<version>.json for manifests."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 32):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), tuple(keys or ()), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._at(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """The numbers of all versions, rising."""
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The manifest of a version, the latest if not told; None for a table without any."""
        there = self.versions()
        if number is None:
            if not there:
                return None
            number = there[-1]
        elif number not in there:
            raise ValueError(f"there is no version {number}")
        stream = self._fs.open(self._at(self._manifest(number)))
        try:
            return Version.of_json(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self, number: int) -> str:
        return f"{self.path}/log/{number:020d}.json"

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the latest if not told. Later changes don't show in it."""
        v = self.version(number)
        if v is None:
            raise ValueError("the table has no version yet")
        return self._rows(v, [f for own in v.files.values() for f in own])

    def _rows(self, v: Version, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], v.schema)
        return self.spark.read.schema(v.schema).parquet(*(f"{self.path}/data/{f}" for f in files))

    def page(self, keys: list[Column], limit: int, offset: int = 0, number: int | None = None, where: Column | None = None) -> dict:
        """A page and the total of one and the same version, whatever is committed meanwhile."""
        v = self.version(number)
        rows = self.read(v.number)
        return {**paging.envelope(rows if where is None else rows.where(where), keys, limit, offset), "version": v.number}

    def _bucket(self, keys: tuple[str, ...]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int") if keys else F.lit(0)

    def stage(self, rows: DataFrame) -> dict[int, tuple[str, ...]]:
        """Write rows where no reader looks; what commit needs to make them a version's."""
        change = uuid.uuid4().hex
        parted = rows.withColumn(BUCKET, self._bucket(self.keys))
        if self.keys:
            parted = parted.repartition(BUCKET) if self.buckets > 1 else parted
        parted.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{change}")
        return {int(n.split("=")[1]): (f"{change}/{n}",) for n in self._names(f"{self.path}/data/{change}") if n.startswith(f"{BUCKET}=")}

    def commit(self, expected: int, operation: str, schema: StructType, files: dict[int, tuple[str, ...]]) -> Version:
        """Make version expected + 1 of these files; Conflict if it exists or expected isn't the latest."""
        there = self.versions()
        if (there[-1] if there else 0) != expected:
            raise Conflict(f"the latest version is {there[-1] if there else 0} and not {expected}")
        v = Version(expected + 1, operation, schema, self.keys, files)
        draft = f"{self.path}/log/draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft), False)
        out.write(bytearray(v.to_json().encode()))
        out.close()
        try:
            self._put(draft, self._manifest(v.number))
        finally:
            self._fs.delete(self._at(draft), False)
        return v

    def _put(self, draft: str, manifest: str) -> None:
        """Name a written manifest, unless the name is taken: a hard link on local disks, elsewhere the store's own rename, which must be atomic."""
        try:
            if self._fs.getScheme() == "file":
                name = lambda p: self._jvm.java.nio.file.Path.of(self._fs.makeQualified(self._at(p)).toUri())
                self._jvm.java.nio.file.Files.createLink(name(manifest), name(draft))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                context.rename(self._at(draft), self._at(manifest), options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"{manifest} was made meanwhile") from None
            raise

    # changes, each a version of its own

    def overwrite(self, rows: DataFrame, expected: int | None = None) -> Version:
        """rows instead of all there is."""
        expected = self._latest() if expected is None else expected
        return self.commit(expected, "overwrite", rows.schema, self.stage(rows))

    def append(self, rows: DataFrame, expected: int | None = None) -> Version:
        v = self._base(expected)
        return self.commit(v.number, "append", v.schema, _added(v.files, self.stage(rows.select(*v.schema.names))))

    def replace_keys(self, rows: DataFrame, expected: int | None = None) -> Version:
        """All rows of the keys that rows has give way to rows; other buckets' files are taken over as they are."""
        return self._rewritten("replace", rows, lambda old: old.join(rows.select(*self.keys).distinct(), list(self.keys), "left_anti").unionByName(rows), rows, expected)

    def delete_keys(self, gone: DataFrame, expected: int | None = None) -> Version:
        return self._rewritten("delete", gone, lambda old: old.join(gone.select(*self.keys).distinct(), list(self.keys), "left_anti"), None, expected)

    def _rewritten(self, operation: str, touched: DataFrame, change, fresh: DataFrame | None, expected: int | None) -> Version:
        if not self.keys:
            raise ValueError("a table without keys is only overwritten and appended to")
        v = self._base(expected)
        buckets = {r[0] for r in touched.select(self._bucket(self.keys)).distinct().collect()}  # no more than there are buckets
        old = self._rows(v, [f for b, own in v.files.items() if b in buckets for f in own])
        new = self.stage(change(old).select(*v.schema.names)) if buckets else {}
        return self.commit(v.number, operation, v.schema, {**{b: f for b, f in v.files.items() if b not in buckets}, **new})

    def _latest(self) -> int:
        there = self.versions()
        return there[-1] if there else 0

    def _base(self, expected: int | None) -> Version:
        v = self.version(expected)
        if v is None:
            raise ValueError("the table has no version yet")
        return v

    def sweep(self, keep: int, older_than_seconds: float = 86_400) -> list[str]:
        """Remove what neither the last `keep` versions nor a young change has: old manifests, files of failed changes. The names of what went."""
        there = self.versions()
        used = {f.split("/")[0] for n in there[-keep:] for own in self.version(n).files.values() for f in own}
        before = (time.time() - older_than_seconds) * 1000
        gone = [self._manifest(n) for n in there[:-keep]]
        for s in self._fs.listStatus(self._at(f"{self.path}/data")) if self._fs.exists(self._at(f"{self.path}/data")) else []:
            if s.getPath().getName() not in used and s.getModificationTime() <= before:
                gone.append(f"{self.path}/data/{s.getPath().getName()}")
        for path in gone:
            self._fs.delete(self._at(path), True)
        return gone


def _added(old: dict[int, tuple[str, ...]], new: dict[int, tuple[str, ...]]) -> dict[int, tuple[str, ...]]:
    return {b: (*old.get(b, ()), *new.get(b, ())) for b in {*old, *new}}
