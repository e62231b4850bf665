import duckdb
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import line_templates, queries

SF = "/root/testdata/sf0.01"


def texts_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = "doc_id, n_lines, n_dropped, text_md5"
    want = con.execute(f'SELECT {cols} FROM ({queries.ORACLE_SQL["op9_line_templates"]})').fetchall()
    assert sorted(map(tuple, queries.op9_line_templates(spark, SF).select(*cols.split(", ")).collect())) == sorted(want)
    assert sum(r[2] for r in want)


def test_numbers_and_names_are_variables(spark):
    people = "ann bob cat dan eve fay gus hal".split()
    rows = [(i, f"{prose(i, 30)}\nPage {i} of 99 printed\nuser logged in from {people[i]} at the north gate\n{prose(50 + i, 20)}") for i in range(8)]
    found = texts_of(line_templates.drop_recurring_lines(documents(spark, rows)))
    assert found[0]["text"] == rows[0][1] and found[0]["n_dropped"] == 0
    for i in range(1, 8):
        assert found[i]["text"] == f"{prose(i, 30)}\n{prose(50 + i, 20)}" and found[i]["n_dropped"] == 2 and found[i]["n_lines"] == 4


def test_rare_and_unlike_lines_stay(spark):
    rows = [(i, f"alpha beta gamma {prose(i, 12)}\nonly in four of them" if i < 4 else f"alpha beta gamma {prose(i, 12)}") for i in range(9)]
    found = texts_of(line_templates.drop_recurring_lines(documents(spark, rows)))
    assert all(found[i]["n_dropped"] == 0 and found[i]["text"] == rows[i][1] for i in range(9))


def test_a_leaf_holds_several_templates(spark):
    """Two patterns of half a leaf each and a frequent variant of one, among unrelated lines of the same beginning and length."""
    colours = "red blue green amber black white".split()
    rows, stays = [], {}
    for i in range(60):
        noise = f"from the old {prose(3000 + i, 5)}"
        a = f"from the old {'mill' if i % 3 else colours[i % 6]} we greet you warmly"
        b = f"from the old house nobody ever came {colours[i // 10]}"
        own = a if i % 2 else b if i < 30 else noise
        rows.append((i, f"{prose(i, 30)}\n{own}"))
        stays[i] = rows[-1][1] if i in (0, 1) or own == noise else prose(i, 30)
    found = texts_of(line_templates.drop_recurring_lines(documents(spark, rows)))
    assert {i: found[i]["text"] for i in stays} == stays


def test_short_lines_and_lines_of_variables(spark):
    rows = [(i, f"{prose(i, 30)}\nAdvertisement\nRead more\n{i}\n12 {i}") for i in range(7)]
    found = texts_of(line_templates.drop_recurring_lines(documents(spark, rows)))
    assert found[0]["text"] == rows[0][1]
    assert all(found[i]["text"] == f"{prose(i, 30)}\n{i}\n12 {i}" and found[i]["n_dropped"] == 2 for i in range(1, 7))


def test_long_text_and_repeated_ids(spark):
    """200,000 lines, many of them to drop; rows that share an id but not their text are told apart."""
    many = "\n".join(f"same line {'abcde'[i % 5]}" if i % 2 else f"{prose(i, 2)} own" for i in range(200_000))
    rows = [*((i, "\n".join(f"same line {x}" for x in "abcde")) for i in range(5)), (7, many), (7, "x y z"), (7, "w\nsame line a")]
    found = line_templates.drop_recurring_lines(documents(spark, rows)).collect()
    of_seven = sorted(((r["text"], r["n_dropped"]) for r in found if r["doc_id"] == 7), key=lambda r: len(r[0]))
    assert of_seven[:2] == [("w", 1), ("x y z", 0)]
    assert of_seven[2][1] >= 100_000 and "same line" not in of_seven[2][0]


def test_masking(spark):
    text = " a  b1\tc \n\n 42 x7y\nplain line"
    row = spark.createDataFrame([(text,)], "text string").select(line_templates.masked_lines(F.col("text")).alias("m")).first()
    assert row["m"] == ["a <*> c", "", "<*> <*>", "plain line"]


def test_case_is_folded(spark):
    footers, pages = ("Read More Here", "READ MORE HERE", "Read more here"), ("Printed PAGE {}", "printed page {}", "Printed Page {}")
    rows = [(i, f"{prose(i, 30)}\n{footers[i % 3]}") for i in range(9)] + [(i, f"{prose(i, 30)}\n{pages[i % 3].format(i)}\nÉTAT DES LIEUX" + ("" if i % 2 else "\nétat des lieux")) for i in range(10, 19)]
    found = texts_of(line_templates.drop_recurring_lines(documents(spark, rows)))
    assert all(found[i]["text"] == rows[i if i < 9 else i - 1][1] and found[i]["n_dropped"] == 0 for i in (0, 10))
    assert all(found[i]["text"] == prose(i, 30) and found[i]["n_dropped"] for i in (*range(1, 9), *range(11, 19)))


def test_odd_rows(spark):
    rows = [*ODD, *((i, "same old footer line\nown " + prose(i, 5)) for i in range(10, 18)), (None, "same old footer line")]
    docs = documents(spark, rows)
    for c in ("line", "leaf", "pos", "drop", "lines", "row", "__drop", "__stays", "score", "c1"):
        docs = docs.withColumn(c, F.lit("x"))
    docs = docs.withColumn("n_lines", F.lit("y"))
    found = line_templates.drop_recurring_lines(docs).collect()
    assert len(found) == len(rows) and sorted(found[0].asDict()) == sorted([*docs.columns, "n_dropped"])
    texts = [(r["doc_id"], r["text"]) for r in found]
    assert texts.count((None, "same old footer line")) == 1 and texts.count((1, None)) == 1 and texts.count((2, "")) == 1
    assert sum("footer" in (t or "") for _, t in texts) == 2
    assert line_templates.drop_recurring_lines(docs.limit(0)).collect() == []
