import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def plain(rows):
    """The contract's figures with one eigendecomposition of an exact covariance."""
    good = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    off = np.array([[n * x[k] - s[k] for k in range(d)] for x in fit], float) / n
    v = off.T @ off / n
    e, vectors = np.linalg.eigh(v)
    order = np.argsort(-e)
    return good, n, s, v, e[order], vectors[:, order].T


def check(rows, found, components=16):
    good, n, s, v, e, vectors = plain(rows)
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    assert len(found) == k * len(good)
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, x in good:
        off = [n * a - b for a, b in zip(x, s)]
        for c in range(1, k + 1):
            r = by[i, c].pop()
            assert r["n"] == n and r["deviation"] == sum(o * o for o in off)
            assert abs(r["explained"] / (e[c - 1] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-7
            want = float(np.array([float(Fraction(o, n)) for o in off]) @ vectors[c - 1]) / math.sqrt(e[c - 1])
            if abs(want) > 1e-3:
                sign = signs.setdefault(c, math.copysign(1, want * r["whitened"]))
                assert abs(want - sign * r["whitened"]) < 1e-6
    assert all(not left for left in by.values())


def test_whitening_equals_one_decomposition(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(23)  # three levels of merging
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check(rows, whitening.whiten(df).collect())


def test_parts_merge_without_loss():
    """Merging in any grouping gives the covariance of all rows, also where the mean is far off and dimensions are dependent."""
    r = np.random.default_rng(5)
    x = (r.normal(size=(300, 6)) * [900, 300, 70, 20, 4, 0] + 4_000_000_000).astype(np.int64)
    x[:, 5] = 2 * x[:, 0]
    cuts = [0, 1, 3, 100, 250, 300]
    parts = [whitening.part_of(x[a:b]) for a, b in zip(cuts, cuts[1:])]
    one = parts[0]
    for p in parts[1:]:
        one = whitening.merged(one, p)
    other = whitening.merged(whitening.merged(parts[3], parts[1]), whitening.merged(parts[4], whitening.merged(parts[0], parts[2])))
    off = (x - x.mean(0, dtype=np.longdouble)).astype(float)
    v = off.T @ off
    for p in (one, other):
        assert p.n == 300 and list(p.sums) == [sum(map(int, c)) for c in x.T]
        assert np.abs((p.vectors.T * p.values**2) @ p.vectors - v).max() < 1e-9 * v.max()


def test_odd_vectors(spark):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=5).tolist()) for i in range(40)]
    rows += [(50, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (60, None), (61, []), (62, [1.0, None, 1.0, 1.0, 1.0]), (63, [float("nan")] * 5), (64, [1.0, float("inf"), 1.0, 1.0, 1.0]), (65, [1e30] * 5)]
    df = spark.createDataFrame([*rows, (66, [1.0, 2.0])], SCHEMA)
    df = df.withColumn("x", F.lit("z")).withColumn("component", F.lit(1)).withColumn("n", F.lit(None))
    found = whitening.whiten(df).collect()
    assert {x["component"] for x in found} == {1, 2, 3, 4, 5}
    check([x for x in rows if x[0] != 65], found)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_flat_directions_have_no_component(spark):
    rows = [(i, [float(i % 7), float(i % 7), float(i // 7)]) for i in range(35)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x["component"] for x in found} == {1, 2}
    check(rows, found)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i) * 1e13, 1.0 + i % 3]) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert found and any(x["deviation"] is None for x in found)
    s = sum(math.floor(64 * i * 1e13) + 1_000_000 for i in range(30))
    t = sum(math.floor(64 * (1.0 + i % 3)) + 1_000_000 for i in range(30))
    for x in found:
        i = x["vec_id"]
        want = (30 * (math.floor(64 * i * 1e13) + 1_000_000) - s) ** 2 + (30 * (math.floor(64 * (1.0 + i % 3)) + 1_000_000) - t) ** 2
        assert x["deviation"] == (want if want < 1 << 63 else None)
