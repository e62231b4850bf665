"""Workbooks (.xlsx) as a Spark data source: all cells as text, so codes keep their leading zeros.

    spark.dataSource.register(SpreadsheetSource)
    spark.read.format("xlsx_text").option("required", "code,name").option("keys", "code").load(path)

Options: sheet (a name; all sheets if not told, which must have the same header),
required (columns that must be there), keys (rows lacking one are left out), block (rows
of a partition, 50000). A partition is a block of rows of one sheet of one file.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Names that the format fixes.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


@dataclass
class Block(InputPartition):
    file: str
    sheet: str
    first: int  # rows from first to before end, counted from 1, the header being 1
    end: int | None


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
    return store, inner


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, inner = _opened(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    there = store.get_file_info(fs.FileSelector(inner))
    return [posixpath.join(path, i.base_name) for i in sorted(there, key=lambda i: i.path) if i.base_name.endswith(".xlsx") and not i.base_name.startswith("~")]


class Workbook:
    def __init__(self, path: str):
        store, inner = _opened(path)
        self.zip = zipfile.ZipFile(store.open_input_file(inner))
        links = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels").iter(_RELS)}
        self.sheets = {s.get("name"): posixpath.normpath(posixpath.join("/xl", links[s.get(_LINK)])).lstrip("/") for s in self._tree("xl/workbook.xml").iter(f"{_MAIN}sheet")}

    def _tree(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        return ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in self._tree("xl/sharedStrings.xml").iter(f"{_MAIN}si")]

    def last_row(self, sheet: str) -> int | None:
        """What the sheet says of its size, if it does."""
        with self.zip.open(self.sheets[sheet]) as f:
            said = re.search(rb'<dimension ref="[A-Z]+[0-9]+:[A-Z]+([0-9]+)"', f.read(4096))
        return int(said[1]) if said else None

    def rows(self, sheet: str, first: int = 1, end: int | None = None) -> Iterator[tuple[int, dict[int, str]]]:
        """(number, cells by column from 0); empty cells are left out."""
        strings = self._strings()
        number = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r") or number + 1)
                if end is not None and number >= end:
                    return
                if number >= first:
                    cells = {}
                    for i, c in enumerate(row.iter(f"{_MAIN}c")):
                        text = self._text(c, strings)
                        if text.strip():
                            cells[_column(c.get("r")) if c.get("r") else i] = text.strip()
                    yield number, cells
                row.clear()

    @staticmethod
    def _text(cell, strings: list[str]) -> str:
        kind = cell.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        value = cell.findtext(f"{_MAIN}v") or ""
        if kind == "s":
            return strings[int(value)] if value else ""
        return {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


class SpreadsheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_text"

    def _sheets(self) -> Iterator[tuple[str, Workbook, str]]:
        for file in _files(self.options["path"]):
            book = Workbook(file)
            wanted = self.options.get("sheet")
            if wanted and wanted not in book.sheets:
                raise ValueError(f"{file} has no sheet {wanted}")
            for sheet in [wanted] if wanted else book.sheets:
                yield file, book, sheet

    def _header(self, book: Workbook, sheet: str) -> list[str]:
        cells = dict(next(book.rows(sheet, 1, 2), (1, {}))[1])
        return [cells.get(i, f"column{i + 1}") for i in range(max(cells, default=-1) + 1)]

    def schema(self) -> StructType:
        headers = {(file, sheet): self._header(book, sheet) for file, book, sheet in self._sheets()}
        names = next(iter(headers.values()), [])
        if missing := [c for c in _list(self.options.get("required")) if c not in names]:
            raise ValueError(f"columns missing: {', '.join(missing)}")
        if other := [at for at, header in headers.items() if header != names]:
            raise ValueError(f"the header of {other[0][1]} in {other[0][0]} is another than the first")
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        size = int(self.options.get("block", 50_000))
        blocks = []
        for file, book, sheet in self._sheets():
            last = book.last_row(sheet)
            if last is None:
                blocks.append(Block(file, sheet, 2, None))
            else:
                blocks += [Block(file, sheet, at, min(at + size, last + 1)) for at in range(2, last + 1, size)]
        return SpreadsheetReader(schema, blocks, _list(self.options.get("keys")))


def _list(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


class SpreadsheetReader(DataSourceReader):
    def __init__(self, schema: StructType, blocks: list[Block], keys: list[str]):
        self.names, self.blocks, self.keys = schema.names, blocks, keys

    def partitions(self) -> list[Block]:
        return self.blocks

    def read(self, partition: Block) -> Iterator[tuple]:
        for _, cells in Workbook(partition.file).rows(partition.sheet, partition.first, partition.end):
            row = tuple(cells.get(i) for i in range(len(self.names)))
            if any(v is not None for v in row) and all(row[self.names.index(k)] is not None for k in self.keys):
                yield row
