import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import lines, segments
from marlstone.plans import catalog

SF = "/root/testdata/sf0.001"
SCHEMA = "id long, t string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(6)
    pieces = ["HEAD a", "HEAD b", "OPEN", "row 1", "text.", "", "x@y", "7 z"]
    texts = [(i, "\n".join(r.choices(pieces, k=r.choice([0, 1, 2, 9, 60])))) for i in range(150)]
    return spark.createDataFrame([*texts, (900, None), (901, ""), (902, "HEAD a"), (903, "OPEN")], SCHEMA).persist()


def same(found, want):
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.select(*found.columns).collect()), key=repr)


def test_the_rows_of_the_window_forms(docs):
    rows = segments.lines(docs, "id", "t")
    head = F.col("line").startswith("HEAD")
    is_head = lambda x: x.startswith("HEAD")
    found = lines.in_blocks(docs, "id", "t", is_head)
    numbered = segments.numbered_blocks(rows, "id", head)
    same(lines.block_texts(found, "id"), segments.block_texts(numbered, "id"))
    same(lines.carry_forward(docs, "id", "t", is_head, lambda x: x, "heading").select("id", "line_no", "heading"), segments.carry_forward(rows, "id", head, F.col("line"), "heading"))
    same(lines.with_next(docs, "id", "t", lambda x, y: is_head(x) & (F.length(y) > 4)), segments.with_next(rows, "id").where(head & (F.length("next_line") > 4)))
    same(lines.gated(docs, "id", "t", lambda x: x == "OPEN"), segments.gated(rows, "id", F.col("line") == "OPEN"))
    kinds = {"address": F.col("line").contains("@"), "number": F.col("line").rlike("^[0-9]")}
    tests = {"address": lambda x: x.contains("@"), "number": lambda x: x.rlike("^[0-9]")}
    want = segments.block_fields(numbered, ["id", "block_no"], "last", F.upper("line"), F.col("line").rlike("[.]$"), kinds)
    same(lines.block_fields(found, ["id", "block_no"], "last", F.upper, lambda x: x.rlike("[.]$"), tests), want)
    told = rows.withColumn("h", F.when(head, F.col("line")))
    want = told.withColumn("new", segments.changed_from_previous(told, "id", "h")).groupBy("id").agg(F.count_if("new").cast("int").alias("n"))
    same(docs.where("t is not null").select("id", lines.heading_changes(F.split("t", "\n"), is_head, lambda x: x).alias("n")), want)


@pytest.mark.parametrize("name", ["line_blocks", "carry_forward", "lookahead", "gate", "block_fields", "repeated_headings"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "\n".join("HEAD" if i % 3 == 0 else f"line {i}" for i in range(60_000)))], SCHEMA)
    assert lines.in_blocks(df, "id", "t", lambda x: x == "HEAD").count() == 20_000
    assert lines.carry_forward(df, "id", "t", lambda x: x == "HEAD", lambda x: x, "h").count() == 60_000
