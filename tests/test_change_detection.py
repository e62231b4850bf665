import hashlib

from pyspark.sql import functions as F

from marlstone.operators import digests
from marlstone.plans import catalog


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_no_task_holds_a_source(spark):
    """What is gathered is a block of ids, or the digests of some neighbouring blocks."""
    rows = spark.range(5000).withColumn("source", F.lit("hot")).withColumn("text", F.col("id").cast("string"))
    bottom = digests.blocks(rows, ["source"], "id", F.col("text"), size=16)
    assert bottom.agg(F.max("n")).first()[0] == 16
    levels = digests.tree(bottom, ["source"], fan=8, levels=3)
    assert [x.count() for x in levels] == [40, 5, 1, 1] and levels[-1].first()["n"] == 5000


def test_digests_are_those_of_the_definition(spark):
    rows = [("s", 1, "a"), ("s", 0, "b"), ("s", 5, None), ("s", 5, None), ("s", None, "z"), (None, 2, "c")]
    df = spark.createDataFrame(rows, "source string, id long, text string")
    bottom = digests.blocks(df, ["source"], "id", F.col("text"), size=4)
    zero, one = sha(f"0:{sha('b')},1:{sha('a')}"), sha(f"5:{sha('')}")
    assert sorted((r["block_no"], r["n"], r["ids"], r["digest"]) for r in bottom.where("source = 's'").collect()) == [(0, 2, "0,1", zero), (1, 1, "5", one)]
    root = digests.tree(bottom, ["source"], fan=2, levels=1)[-1]
    assert root.where("source = 's'").first()["digest"] == sha(sha(f"{zero},{one}")) and root.count() == 2


def test_one_changed_row_is_seen(spark, tmp_path):
    """src2 gains a span of ids; src0 has the same rows twice over in both states; of src4 a text of equal length is another."""
    rows = [(s, i, 5) for s in ("src0", "src0", "src1", "src3", "src4") for i in range(2, 9, 2)] + [("src2", i, 5) for i in (2, 3, 22, 130)] + [("src4", 304, 5), ("src4", 500, 5)]
    spark.createDataFrame(rows, "source string, doc_id long, n_chars long").withColumn("text", F.lit("hello")).withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["change_detection"](spark, str(tmp_path))
    assert dict(found.collect()) == {"src0": "unchanged", "src1": "failed", "src2": "imported", "src3": "unchanged", "src4": "imported"}
    assert sorted(map(tuple, catalog.QUERIES["changed_blocks"](spark, str(tmp_path)).collect())) == [("src2", 0, "changed"), ("src4", 0, "changed"), ("src4", 4, "changed")]


def test_added_and_removed_blocks(spark):
    rows = spark.range(2000).withColumn("source", F.lit("a")).withColumn("text", F.lit("x"))
    before = digests.blocks(rows.where("id < 1500 and id <> 700"), ["source"], "id", F.col("text"), size=10)
    now = digests.blocks(rows.where("id not between 300 and 319"), ["source"], "id", F.col("text"), size=10)
    found = {(r["block_no"], r["change"]) for r in digests.changed_blocks(before, now, ["source"], fan=4, levels=2).collect()}
    assert found == {(30, "removed"), (31, "removed"), (70, "changed"), *((b, "added") for b in range(150, 200))}
    assert digests.changed_blocks(now, now, ["source"], fan=4, levels=2).count() == 0
