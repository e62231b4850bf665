import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import identity, paging

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(9)
    made = [(i, None if i % 17 == 0 else r.choice(["a", "b", "b", "b", "é", "z"]), r.choice([None, float("nan"), *map(float, range(40))])) for i in range(3000)]
    return spark.createDataFrame(made, "id long, s string, x double").repartition(5).persist()


@pytest.mark.parametrize("order", [[("s", False), ("x", True), ("id", False)], [("s", True), ("id", True)], [("x", False), ("s", False), ("id", True)], [("id", False)]])
def test_deep_pages_are_those_of_a_sort(rows, order):
    want = [r["id"] for r in rows.orderBy(*paging._sort_keys(order)).collect()]
    for offset in (0, 1, 170, 1500, 2790, 2985, 3000, 9000):
        found = paging.deep_page(rows, order, limit=25, offset=offset, enough=100, ranges=8)
        assert [r["id"] for r in found.collect()] == want[offset : offset + 25]


def test_a_far_offset(spark):
    """Only a small part of the table is sorted for the page, and what is known filters the scan."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    order = [("o_orderdate", False), ("o_orderkey", False)]
    found = paging.deep_page(orders, order, limit=30, offset=100_000, enough=5000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan.split("PushedFilters")[1] and int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) < 6000
    want = orders.orderBy("o_orderdate", "o_orderkey").collect()[100_000:100_030]
    assert found.collect() == want


def test_seeking_goes_through_the_whole_table(rows):
    order = [("s", True), ("x", False), ("id", False)]
    want = [r["id"] for r in rows.orderBy(*paging._sort_keys(order)).collect()]
    nan_free = rows.where("not isnan(x) or x is null")
    want = [r["id"] for r in nan_free.orderBy(*paging._sort_keys(order)).collect()]
    got, page = [], nan_free.orderBy(*paging._sort_keys(order)).limit(700).collect()
    while page:
        got += [r["id"] for r in page]
        page = paging.page_after(nan_free, order, tuple(page[-1][k] for k, _ in order), limit=700).collect()
    assert got == want


def test_bad_pages(rows):
    for how in ({"limit": 0, "offset": 0}, {"limit": 5000, "offset": 0}, {"limit": 1, "offset": -1}):
        with pytest.raises(ValueError):
            paging.deep_page(rows, [("id", False)], **how)
    with pytest.raises(ValueError):
        paging.page_after(rows, [("id", False)], (1, 2), 5)


def test_numbers_have_no_gap(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("__x")).repartition(9)
    found = identity.numbered(df, ["k"], "n", first=100)
    assert found.columns == ["k", "__x", "n"] and all(r["n"] == r["k"] + 100 for r in found.collect())
    assert identity.numbered(df.limit(0), ["k"], "n").collect() == []


def test_no_task_holds_all_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("k")).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one task
    try:
        found = identity.numbered(df, ["k"], "n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    held = found.groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(held) > 2 and max(r["count"] for r in held) < 12_000


def test_inserts(spark):
    old = spark.createDataFrame([(5, "a", 1), (9, None, 1)], "id long, k string, j int")
    new = spark.createDataFrame([("c", 1, "x"), ("b", 1, "y"), ("b", 1, "z"), ("a", 1, "old"), ("a", 2, "w"), (None, 1, "null"), (None, 2, "q")], "k string, j int, v string")
    found = sorted(map(tuple, identity.insert_returning_ids(old, new, ["k", "j"], "id").collect()))
    assert found == [(10, None, 2, "q"), (11, "a", 2, "w"), (12, "b", 1, "z"), (13, "c", 1, "x")]
    assert [r["id"] for r in identity.insert_returning_ids(old.limit(0), new, ["k", "j"], "id").orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    assert identity.insert_returning_ids(old, new.limit(0), ["k", "j"], "id").collect() == []
