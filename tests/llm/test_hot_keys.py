"""A third of the rows have one line, one unit or one item: results are right, and no shuffle of a join holds the hot key whole."""

import pytest
from pyspark.sql import functions as F

from helpers import documents, prose
from marlstone.llm import common, decontam, line_templates, substring_dedup

N = 900
HOT = "all rights of this long licence line are reserved by the owners of this very place here"


@pytest.fixture
def hot_docs(spark):
    return documents(spark, [(i, (f"{HOT}\n" if i % 3 == 0 else "") + prose(i, 60)) for i in range(N)])


def test_substring(hot_docs):
    found = substring_dedup.repeated_units(hot_docs).collect()
    hot = [r for r in found if r["kept_doc_id"] == 0 and r["start"] == 0]
    assert {r["doc_id"] for r in hot} == {i for i in range(3, N, 3)}


def test_lines(hot_docs):
    found = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(hot_docs).select("doc_id", "text").collect()}
    assert [i for i, t in found.items() if HOT in t] == [0]


def test_a_template_of_many_different_lines(spark):
    """One template in a third of the rows, each line another."""
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    docs = documents(spark, [(i, (f"the report of today was sent by {word(i)} to all of the staff\n" if i % 3 == 0 else "") + prose(i, 40)) for i in range(N)])
    found = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs).select("doc_id", "text").collect()}
    assert [i for i, t in found.items() if "report of today" in t] == [0]


def test_items(spark):
    item = "what is the name of the river that runs by the old town hall"
    docs = documents(spark, [(i, (item if i % 3 == 0 else "") + " " + prose(i, 30)) for i in range(N)])
    bench = spark.createDataFrame([(1, item), (2, item + " and the new one"), (3, prose(5000, 20))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert {i for i, k in found if k == 1} == set(range(0, N, 3)) and not any(k == 3 for _, k in found)


def test_salted_join_equals_a_join(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 == 0 else i % 50) for i in range(6000)], "row long, k long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (99, "d")], "k long, v string")
    weighed = right.join(left.groupBy("k").agg(F.count(F.lit(1)).alias("w")), "k")
    found = common.join_salted(left, weighed, "k", "w", 6000)
    assert sorted(found.collect()) == sorted(left.join(right, "k").collect())
    parts = left.join(weighed, "k").select("k", F.ceil(F.col("w") * common.HOT_KEYS / 6000).alias("p")).where("k = 1").first()["p"]
    assert parts > 1000


def test_bitmap_grows_with_the_seeds_within_bounds():
    assert [decontam.bitmap_bits(n) for n in (0, 1000, 1 << 20, 1 << 22, 1 << 40)] == [23, 23, 25, 27, 29]
