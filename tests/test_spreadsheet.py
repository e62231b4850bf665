import zipfile
from xml.sax.saxutils import escape

import pytest

from marlstone.sources import tables
from marlstone.sources.spreadsheet import SpreadsheetSource

SF = "/root/testdata/sf0.001"
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(i):
    return chr(65 + i) if i < 26 else letters(i // 26 - 1) + chr(65 + i % 26)


def workbook(path, sheets, shared=True, dimension=True):
    """sheets: name -> rows of strings, numbers, booleans and None."""
    strings: list[str] = []

    def cell(r, i, v):
        at = f"{letters(i)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v}</v></c>'
        if not shared:
            return f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        strings.append(v)
        return f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i else ""}worksheets/sheet{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, k, v) for k, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            size = f'<dimension ref="A1:{letters(max(map(len, rows)) - 1)}{len(rows)}"/>' if dimension and rows else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}>{size}<sheetData>{body}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r></si>" for s in strings) + "</sst>")


@pytest.fixture
def load(spark):
    spark.dataSource.register(SpreadsheetSource)
    return lambda path, **options: spark.read.format("xlsx_text").options(**options).load(str(path))


@pytest.mark.parametrize("shared,dimension", [(True, True), (False, False)])
def test_a_table_comes_back(spark, load, tmp_path, shared, dimension):
    rows = [(f"{r['s_suppkey']:08d}", r["s_name"], str(r["s_nationkey"]), repr(r["s_acctbal"])) for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()] * 30
    workbook(tmp_path / "a.xlsx", {"one": [("code", "name", "nation", "balance"), *((a, b, int(c), float(d)) for a, b, c, d in rows)]}, shared, dimension)
    df = load(tmp_path / "a.xlsx", required="code,name", keys="code", block=64)
    assert df.columns == ["code", "name", "nation", "balance"] and {t for _, t in df.dtypes} == {"string"}
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    assert df.rdd.getNumPartitions() == (-(-len(rows) // 64) if dimension else 1)


def test_sheets_files_and_gaps(load, tmp_path):
    head = ["code", None, "a & b"]
    workbook(tmp_path / "a.xlsx", {"x": [head, ["007", True, None], [None, "q", "z"], [None, None, None]], "y": [head, ["1", " ", "v"]]})
    workbook(tmp_path / "b.xlsx", {"x": [head, ["2", None, 1.5]]})
    df = load(tmp_path, keys="code")
    assert df.columns == ["code", "column2", "a & b"]
    assert sorted(map(tuple, df.collect())) == [("007", "true", None), ("1", None, "v"), ("2", None, "1.5")]
    assert load(tmp_path, sheet="x").count() == 3


def test_wrong_workbooks_are_refused(load, tmp_path):
    workbook(tmp_path / "a.xlsx", {"x": [["code", "name"], ["1", "a"]], "y": [["other"], ["1"]]})
    for options, said in (({"required": "code,lat"}, "lat"), ({"sheet": "z"}, "no sheet"), ({}, "header")):
        with pytest.raises(Exception, match=said):
            load(tmp_path / "a.xlsx", **options).collect()


def test_quoted_commas_in_a_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code,"name, full",x\n007,"Ana, B",1\n')
    df = tables.text_columns(spark, str(tmp_path / "a.csv"), ["name, full"], ["code"])
    assert [tuple(r) for r in df.collect()] == [("007", "Ana, B", "1")] and df.columns == ["code", "name, full", "x"]
