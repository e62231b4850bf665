"""Buckets that outgrow their bound are compared in blocks, and lose no link."""

import numpy as np
import pytest

from marlstone.llm import simhash
from test_simhash import plain_components


@pytest.mark.parametrize("bucket_rows", [8, 50, 1 << 16])
def test_large_buckets(spark, bucket_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        r = np.random.default_rng(4)
        base = int(r.integers(0, 2**62))
        fps = {base}
        while len(fps) < 220:  # a dense cloud that differs in few bits
            x = base
            for bit in r.choice(14, int(r.integers(1, 7)), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
        nodes = sorted(fps) + [int(x) for x in r.integers(-(2**63), 2**63, 80)]
        reps = spark.createDataFrame([(f, i) for i, f in enumerate(nodes)], "fp long, node long")
        links = [(x["a"], x["b"]) for x in simhash.fingerprint_links(reps, distance=2, bucket_rows=bucket_rows).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = lambda a, b: ((nodes[a] ^ nodes[b]) & (2**64 - 1)).bit_count() <= 2
    assert all(near(a, b) for a, b in links)
    every = [(a, b) for a in range(len(nodes)) for b in range(a) if near(a, b)]
    assert plain_components(links, range(len(nodes))) == plain_components(every, range(len(nodes)))
