import zlib

import numpy as np
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import compress_quality as cq
from marlstone.llm.common import labelled_sample

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = cq.classify(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    hard, y = (np.array(x) for x in zip(*rows))
    assert hard[y == 1].mean() > 0.98 and hard[y == 0].mean() < 0.15


def test_scores_equal_a_plain_version(spark):
    """Dictionaries, sizes by blocks and the logistic fit, without Spark, on every labelled row."""
    import zstandard

    rows = [(i, ("%%% ### $$$ &&& " if i % 3 == 0 else "") + prose(i, 40 + 5 * (i % 60))) for i in range(120)] + [(500, None), (501, "")]
    labels = [(i, int(i % 3 > 0)) for i in range(100)]
    found = {r["doc_id"]: r["score"] for r in cq.classify(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    texts, known = {d: (t or "").encode() for d, t in rows}, dict(labels)
    order = {r["id"]: r["o"] for r in spark.range(120).select("id", F.xxhash64("id", F.lit(1)).alias("o")).collect()}
    taught = sorted((i for i in known if zlib.crc32(str(i).encode()) % 5), key=lambda i: order[i])
    seen, rest = taught[::2], taught[1::2]
    words = [zstandard.ZstdCompressionDict(cq.dictionary([texts[i] for i in seen if known[i] == label], 32 << 10)) for label in (1, 0)]

    def features(text):
        good, bad = (sum(len(zstandard.ZstdCompressor(level=3, dict_data=w, write_content_size=False).compress(text[a : a + 1024])) for a in range(0, max(1, len(text)), 1024)) for w in words)
        n = max(1, len(text))
        a, b, c = (bad - good) / n, (bad - good) / (bad + good), np.log(n)
        return [a, b, c, a * c, b * c]

    x = np.array([features(texts[i]) for i in rest])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    w = cq.logistic((x - centre) / scale, np.array([known[i] for i in rest], float))
    for i, text in texts.items():
        z = (np.array(features(text)) - centre) / scale @ w[:-1] + w[-1]
        assert abs(found[i] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-6


def test_long_labelled_texts_are_cut_and_not_left_out(spark):
    docs = documents(spark, [(1, "ab" * 5000), (2, "short"), (3, None), (4, "")])
    marks = spark.createDataFrame([(i, 1) for i in range(1, 5)], "doc_id long, label int")
    rows = labelled_sample(docs, marks, 100, 16_000).collect()
    assert "".join(sorted(r["text"] for r in rows if r["doc_id"] == 1)) == "ab" * 5000 and all(len(r["text"] or "") <= 1000 for r in rows)
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] != 1) == [2, 3, 4]


def test_sizes_survive_the_journey():
    import pickle

    good, bad = [b"the quick brown fox jumps " * 5], [b"%%% ### $$$ &&& " * 5]
    sizes = cq.Sizes(cq.dictionary(good, 512), cq.dictionary(bad, 512), 3)
    texts = [b"the quick brown fox", b"### $$$ &&& ###", b""]
    before = sizes.features(texts)
    assert np.array_equal(before, pickle.loads(pickle.dumps(sizes)).features(texts))
    assert before[0, 0] > before[1, 0]


def test_logistic_separates():
    x = np.linspace(-2, 2, 200)[:, None]
    y = (x[:, 0] + np.sin(40 * x[:, 0]) > 0).astype(float)
    w = cq.logistic(x, y)
    p = 1 / (1 + np.exp(-(x[:, 0] * w[0] + w[1])))
    assert abs(p.mean() - y.mean()) < 0.01 and w[0] > 0


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("label", F.lit("x")).withColumn("order", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (6, 0), (77, 1), (None, 1), (5, None)], "doc_id long, quality int")
    found = cq.classify(docs, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert len(cq.classify(docs, labels.limit(0)).collect()) == len(ODD)
    assert cq.classify(docs.limit(0), labels).collect() == []
