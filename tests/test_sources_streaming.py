"""Readers, writers, and streams."""

import base64
import hashlib
import time
from collections import deque

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.sources import sinks, tables
from marlstone.streaming import admission, windows

SF = "/root/testdata/sf0.001"


def test_text_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,name,x\n007,Ana,1\n,Bob,2\n008,,3\n")
    df = tables.text_columns(spark, str(tmp_path / "a.csv"), ["code", "name"], ["code", "name"])
    assert [tuple(r) for r in df.collect()] == [("007", "Ana", "1")] and {t for _, t in df.dtypes} == {"string"}
    with pytest.raises(ValueError, match="missing"):
        tables.text_columns(spark, str(tmp_path / "a.csv"), ["code", "lat"], ["code"])


def test_content_and_changes(spark, tmp_path):
    for name, data in (("a.bin", b"one"), ("b.bin", b"two")):
        (tmp_path / name).write_bytes(data)
    files = tables.files_by_content(spark, str(tmp_path), "*.bin")
    known = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(),)], "sha string")
    assert [r["length"] for r in tables.changed(files, known).collect()] == [3]
    envelope = spark.createDataFrame([(base64.b64encode(b"payload").decode(),)], "p string")
    assert tables.decoded(envelope, "p", 7).first()["big_enough"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, part string")
    out = str(tmp_path / "t")
    sinks.bulk(df, out, ["part"])
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "id int, part string"), out, ["part"])
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 9]
    sinks.json_report(sinks.with_json(df, ["id", "part"]), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert tables.evolve([df, df.drop("part")]).where("part is null").count() == 2


def plain_admission(times, limit, width):
    taken, out = deque(), []
    for t in times:
        while taken and taken[0] <= t - width:
            taken.popleft()
        out.append(len(taken) < limit)
        if out[-1]:
            taken.append(t)
    return out


def test_admission(spark):
    events = tables.table(spark, SF, "events").select("event_id", "user_id", "ts")
    got = admission.admit(events, "user_id", "ts", "event_id", 2, 86_400).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).collect()
    users = {}
    for r in sorted(got, key=lambda r: (r["at"], r["event_id"])):
        users.setdefault(r["user_id"], []).append(r)
    refused = 0
    for rs in users.values():
        want = plain_admission([r["at"] for r in rs], 2, 86_400_000_000)
        assert [r["admitted"] for r in rs] == want
        refused += want.count(False)
    assert refused


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return q


@pytest.mark.parametrize("files", [1, 4])
def test_admission_stream_equals_batch(spark, tmp_path, files):
    """In one micro-batch, and in several of which each has the later times."""
    events = tables.table(spark, SF, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    slots = events.withColumn("slot", F.ntile(files).over(Window.orderBy("ts", "event_id"))).cache()
    for slot in range(1, files + 1):
        slots.where(F.col("slot") == slot).drop("slot").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run(admission.admit_stream(stream, "user_id", "ts", 2, 86_400), f"admitted{files}")
    got = {(r["client"], r["at"]): r["admitted"] for r in spark.sql(f"select * from admitted{files}").collect()}
    batch = admission.admit(events, "user_id", "ts", "event_id", 2, 86_400)
    want = {(str(r["user_id"]), r["at"]): r["admitted"] for r in batch.withColumn("at", F.unix_micros("ts")).collect()}
    assert got == want and len(got) == events.count()
    if files > 1:  # clients without a request in the last day of the watermark have no state
        assert min(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[1:]) < events.select("user_id").distinct().count()
        assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress) > 0


def test_window_counts_stream(spark, tmp_path):
    events = tables.table(spark, SF, "events").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(windows.event_counts(stream, "ts", ["event_type"], "1 day", "1 hour"), "counted")
    got = {tuple(r) for r in spark.sql("select * from counted").collect()}
    want = {tuple(r) for r in windows.event_counts(events, "ts", ["event_type"], "1 day", "1 hour").collect()}
    assert got and got <= want


def test_drain_sends_each_event_once(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "event_key string, n int").coalesce(1).write.parquet(str(tmp_path / "in"))
    sent = []
    stream = spark.readStream.schema("event_key string, n int").parquet(str(tmp_path / "in"))
    q = windows.drain(stream, lambda batch: sent.extend(r["event_key"] for r in batch.collect()), str(tmp_path / "cp"))
    assert q.awaitTermination(120) and sorted(sent) == ["a", "b"]
