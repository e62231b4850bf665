import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import queries, resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, target, percent=10, buckets=10_000, longest=1, min_words=20):
    """(doc_id, n_features, weight, score, rank) of the contract, one text at a time."""

    def features(text):
        words = WORD.findall(lowered(text))
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)

    found = [(i, *features(t)) for i, t in docs]
    s, t = (Counter(b for x in some for b in x) for some in ([f for _, f, _ in found], [features(x)[0] for x in target]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, f, words in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, words])
    able = sorted((r for r in rows if r[5] >= min_words and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_equals_a_plain_version(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [r["text"] for r in bench.collect()]
    for how in ({}, {"longest": 2, "buckets": 997, "percent": 33}):
        assert Counter(map(tuple, resampling.resample(docs, bench, **how).collect())) == plain(rows, target, **how)


def test_the_drawn_are_nearer_to_the_target(spark):
    docs = documents(spark, [(i, ("alpha beta gamma " if i % 2 else "delta epsilon zeta ") * 8) for i in range(400)])
    found = resampling.resample(docs, spark.createDataFrame([("alpha beta gamma " * 50,)], "text string")).where("rank is not null").collect()
    assert len(found) == 40 and sum(r["doc_id"] % 2 for r in found) >= 38


def test_kth_key_is_exact(spark):
    """Against a sort, with ties, negative and extreme keys, for every k."""
    r = random.Random(4)
    for wide in ((-3, 3, 0, 4), (-40_000, 40_000, 0, 1 << 40), (-(1 << 63), (1 << 63) - 1, -(1 << 63), (1 << 63) - 1)):
        keys = [(r.randint(*wide[:2]), r.randint(*wide[2:])) for _ in range(60)]
        keys += keys[:5]
        df = spark.createDataFrame(keys, "a long, b long").coalesce(2).persist()
        for k in (1, 2, 31, len(keys) - 1, len(keys)):
            assert resampling.kth_key(df, ["a", "b"], k) == sorted(keys)[k - 1]
        assert resampling.kth_key(df, ["a", "b"], 0) is None and resampling.kth_key(df, ["a", "b"], len(keys) + 1) is None
        df.unpersist()


def test_ranks_over_ranges(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    assert [r["rank"] for r in resampling.ranked(df, ["a", "b"]).orderBy("a", "b").collect()] == list(range(1, 1001))


def test_equal_scores_and_repeated_rows(spark):
    """Copies of a row tie in everything; as many are drawn as are due."""
    rows = [(i // 10, prose(1, 30)) for i in range(200)]
    found = resampling.resample(documents(spark, rows), spark.createDataFrame([("x",)], "text string")).collect()
    assert len(found) == 200
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))
    assert Counter(map(tuple, found)) == plain(rows, ["x"])


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumns({c: F.lit("z") for c in ("rank", "score", "weight", "n_features", "falling", "part")})
    target = spark.createDataFrame([("word",), (None,)], "text string")
    assert Counter(map(tuple, resampling.resample(docs, target).collect())) == plain(ODD, ["word", None])
    assert Counter(map(tuple, resampling.resample(docs, target.limit(0)).collect())) == plain(ODD, [])
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert len(resampling.resample(docs, target, percent=100).where("rank is not null").collect()) == 1


def test_words_are_those_of_the_pattern():
    texts = ["A-b_c9 Ünï`{z}~ \x7f\x00é@漢字 x[y]", "", "Ⅷ ſ İI", "aİb"]
    for t in texts:
        n, at = resampling.Buckets(10_000).of(t.encode(), 1)
        words = WORD.findall(lowered(t))
        assert n == len(words) and at.tolist() == [zlib.crc32(w.encode()) % 10_000 for w in words]


def test_gains_are_those_of_the_formula():
    s, t = np.array([5, 0, 2]), np.array([0, 7, 1])
    want = [math.floor(1000 * math.log((b + 1) * (7 + 3) / ((a + 1) * (8 + 3)))) for a, b in zip(s, t)]
    assert resampling.gains(s, t).tolist() == want


def test_registered_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES["op13_resampling"](spark, SF)
    want = con.execute(f'SELECT {", ".join(found.columns)} FROM ({queries.ORACLE_SQL["op13_resampling"]})').fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want)
