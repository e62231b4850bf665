import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import sharding

SF = "/root/testdata/sf0.01"


def check(rows, found, shards=8):
    """rows: (doc_id, text). Every row once, with its own digest; slots without a gap; returns the bytes of each shard."""
    told = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, *told(t)) for i, t in rows)
    slots, size = defaultdict(list), Counter({s: 0 for s in range(shards)})
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


def homes(found):
    where = defaultdict(set)
    for r in found:
        where[r["size"], r["text_crc32"]].add(r["shard"])
    return where


def test_shards_of_a_corpus(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    found = sharding.shard(df).collect()
    size = check([(r["doc_id"], r["text"]) for r in df.collect()], found)
    assert max(size.values()) - min(size.values()) < 0.001 * sum(size.values()) / 8
    assert all(len(x) == 1 for x in homes(found).values())


def test_a_hot_text_is_parted_and_others_stay_together(spark):
    """A third of the rows are one text, so more than a shard's share; copies of other texts share a shard."""
    rows = [(i, prose(i % 400, 40) if i % 3 else "hot " * 30) for i in range(3000)]
    found = sharding.shard(documents(spark, rows)).collect()
    size = check(rows, found)
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 8
    where = homes(found)
    hot = max(where, key=lambda k: sum((r["size"], r["text_crc32"]) == k for r in found))
    assert len(where.pop(hot)) >= 3 and all(len(x) == 1 for x in where.values())


def test_a_group_below_a_share_stays_whole(spark):
    rows = [(i, "hot " * 30 if i % 10 == 0 else prose(i, 30)) for i in range(2000)]
    found = sharding.shard(documents(spark, rows)).collect()
    size = check(rows, found)
    assert all(len(x) == 1 for x in homes(found).values())
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 8


def test_few_splitters_are_subdivided(spark, monkeypatch):
    """Where the sample is poor, ranges are overfull; their pieces make shards equal all the same."""
    monkeypatch.setattr(sharding, "RANGES", 16)
    monkeypatch.setattr(sharding, "SAMPLES", 1)
    rows = [(i, prose(i, 20 + i % 50)) for i in range(3000)]
    found = sharding.shard(documents(spark, rows)).collect()
    size = check(rows, found)
    assert max(size.values()) - min(size.values()) < 0.1 * sum(size.values()) / 8


def test_ranges_are_those_of_the_bounds(spark):
    keys = [-(1 << 63), -5, -1, 0, 1, 7, 8, (1 << 63) - 1, 1 << 52, (1 << 52) + 1, -(1 << 52)]
    bounds = sorted([-(1 << 63), -1, 0, 7, 8, (1 << 52) + 1])
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    assert {r["key"]: r["range"] for r in sharding.with_range(df, bounds).collect()} == {k: sum(b <= k for b in bounds) for k in keys}


def test_written_shards_hold_all_columns(spark, tmp_path):
    rows = [(i, prose(i % 90, 25)) for i in range(300)]
    df = documents(spark, rows)
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {*df.columns, "shard", "slot"} <= {*back.columns}
    told = sharding.shard(df, 4)
    assert sorted(back.select("doc_id", "text", "lang", "shard", "slot").collect()) == sorted(told.join(df, "doc_id").select("doc_id", "text", "lang", "shard", "slot").collect())


def test_odd_rows(spark):
    df = documents(spark, ODD).withColumns({c: F.lit("z") for c in ("size", "slot", "range", "key", "piece", "shard", "k0")})
    check(ODD, sharding.shard(df).collect())
    assert sharding.shard(df.limit(0)).collect() == []
    assert sharding.shard(df, keep=["k0", "slot"]).columns[-1] == "k0"
    with pytest.raises(ValueError):
        sharding.shard(df, 0)
