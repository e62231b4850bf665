import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import components, simhash
from marlstone.llm.components import connected_components


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts():
    rows = []
    for base in range(12):
        words = prose(base, 120).split()
        for copy in range(8):
            w = list(words)
            for i in range(copy // 2):
                w[(17 * copy + 31 * i) % len(w)] = "changed"
            rows.append((base * 100 + copy, " ".join(w)))
    return rows + [(5000, ""), (5001, None), (5002, " ")]


def test_fingerprint_is_the_plain_one():
    for text in ["", "A", "a b", "a b c d", prose(3, 50), "É é x Y z " * 7]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_long_text_goes_in_blocks(monkeypatch):
    text = prose(9, 3000)
    monkeypatch.setattr(simhash, "SHINGLE_BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [2, 4])
def test_groups_equal_brute_force(spark, distance):
    rows = near_texts()
    fps = {d: plain_fingerprint(t) for d, t in rows}
    ids = sorted(fps)
    pairs = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= distance]
    want = plain_components(pairs, ids)
    found = simhash.near_duplicate_groups(documents(spark, rows), distance=distance).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {d: f"{f:016x}" for d, f in fps.items()}


def test_dense_fingerprints_lose_no_link(spark):
    """Chains that only step by step lead from one fingerprint to another."""
    r = np.random.default_rng(1)
    fps = [int(x) for x in r.integers(-(2**63), 2**63, 40)]
    for x in list(fps[:8]):
        for _ in range(60):
            for bit in r.choice(64, 3, replace=False):
                x ^= 1 << int(bit)
            x = x - 2**64 if x >= 2**63 else (x + 2**64 if x < -(2**63) else x)
            fps.append(x)
    nodes = list(dict.fromkeys(fps))
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(nodes)], "fp long, node long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(reps).collect()]
    close = lambda a, b: ((nodes[a] ^ nodes[b]) & (2**64 - 1)).bit_count() <= 4
    assert all(close(a, b) for a, b in links)
    every = [(a, b) for a in range(len(nodes)) for b in range(a) if close(a, b)]
    assert plain_components(links, range(len(nodes))) == plain_components(every, range(len(nodes)))


def plain_distinct(text, k):
    words = (text or "").encode().lower().split()
    grams = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))


def edited():
    """Copies of long texts with 1 to 5 words of 250 changed, and texts that only share their language."""
    rows = []
    for base in range(30):
        words = prose(base, 250).split()
        for copy in range(6):
            w = list(words)
            for i in range(copy):
                w[(17 * copy + 53 * i + base) % len(w)] = f"changed{copy}{i}"
            rows.append((base * 10 + copy, " ".join(w)))
    return rows + [(5000, ""), (5001, None), (5002, "one two")]


def test_near_copies_against_all_pairs(spark):
    rows = edited()
    fps = {d: (plain_distinct(t, 1), plain_distinct(t, 2)) for d, t in rows}
    ids = sorted(fps)
    near = lambda a, b, d: (fps[a][0] ^ fps[b][0]).bit_count() <= d and (fps[a][1] ^ fps[b][1]).bit_count() <= 12
    pairs = [(a, b) for a in ids for b in ids if a < b and near(a, b, 8)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, rows)).collect()}
    whole, least = plain_components(pairs, ids), plain_components([p for p in pairs if near(*p, 4)], ids)
    assert sorted(found) == ids
    for a, b in pairs:
        assert found[a] == found[b] or least[a] != least[b]
        assert whole[found[a]] == whole[a]
    told = sum(found[a] == found[b] for a, b in pairs) / len(pairs)
    caught = sum(found[b * 10 + c] == b * 10 for b in range(30) for c in range(1, 6)) / 150
    print("recall of links", told, "of copies", caught)
    assert told > 0.9 and caught > 0.9
    assert all(found[b * 10 + c] // 10 == b for b in range(30) for c in range(6)) and found[5001] == 5000


def test_wide_links_are_all_found(spark):
    """Fingerprints 5 to 8 bits apart that share no three of seven blocks, in small and in dense buckets."""
    r = np.random.default_rng(6)
    nodes = [(int(x), int(y)) for x, y in r.integers(-(2**63), 2**63, (300, 2))]
    for x, y in list(nodes[:200]):
        for n in (5, 6, 7, 8, 9):
            spread = [9 * int(i) + int(r.integers(0, 9)) for i in r.permutation(7)[:n]] + [63] * (n > 7) + [62] * (n > 8)
            far = [int(i) for i in r.choice(64, int(r.integers(0, 14)), replace=False)]
            flipped = [v ^ sum(1 << i for i in set(bits)) % 2**64 if v >= 0 else (v + 2**64) ^ sum(1 << i for i in set(bits)) for v, bits in ((x, spread), (y, far))]
            nodes.append(tuple(v - 2**64 if v >= 2**63 else v for v in flipped))
    x, y = nodes[250]
    nodes += [(x ^ (1 << i) ^ (1 << j), y) for i in range(12) for j in range(i)]
    nodes = list(dict.fromkeys(nodes))
    fps = np.array(nodes, np.int64).view(np.uint64)
    near = (np.bitwise_count(fps[:, None, 0] ^ fps[None, :, 0]) <= 8) & (np.bitwise_count(fps[:, None, 1] ^ fps[None, :, 1]) <= 12)
    every = [(int(a), int(b)) for a, b in np.argwhere(near) if a < b]
    whole = plain_components(every, range(len(nodes)))
    reps = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(nodes)], "fp long, fp2 long, node long")
    for bucket_rows in (simhash.BUCKET_ROWS, 20):
        links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(reps, distance=8, confirm=12, flips=True, bucket_rows=bucket_rows).collect()]
        assert all(near[a, b] for a, b in links) and len(links) < len(every)
        assert plain_components(links, range(len(nodes))) == whole


def test_large_buckets_of_flips(monkeypatch):
    """Compared together or each by itself, buckets connect the same."""
    r = np.random.default_rng(7)
    fp = r.integers(0, 2**63, 400).astype(np.uint64)
    for i in range(100, 400):
        fp[i] = fp[i % 100] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 9)), replace=False)))
    fp = np.unique(fp)
    masks = np.array(simhash.flip_masks(8)[0], np.int64).view(np.uint64)
    rows = sorted((c, int((fp[i] & masks[c]) ^ np.uint64(bit % 2**64)), i) for i in range(len(fp)) for c, bits in enumerate(simhash.flip_masks(8)[1]) for bit in [0, *bits])
    node = np.array([i for _, _, i in rows])
    args = np.array([c for c, _, _ in rows]), np.array([k for _, k, _ in rows], np.uint64).view(np.int64), fp[node], np.zeros(len(node), np.uint64), node, 8, 64, simhash.pivots(16), masks
    every = [(int(a), int(b)) for a, b in np.argwhere(np.bitwise_count(fp[:, None] ^ fp) <= 8) if a < b]
    want = plain_components(every, range(len(fp)))
    for together in (2048, 3, 1):
        monkeypatch.setattr(simhash, "TOGETHER", together)
        a, b = simhash._links_together(*args)
        assert plain_components(zip(a.tolist(), b.tolist()), range(len(fp))) == want
        assert len(set(zip(a.tolist(), b.tolist()))) <= len(every)


def test_near_copies_link_as_all_pairs_do(spark):
    rows = edited()
    fps = {d: (plain_distinct(t, 1), plain_distinct(t, 2)) for d, t in rows}
    ids = sorted(fps)
    near = lambda a, b: (fps[a][0] ^ fps[b][0]).bit_count() <= 8 and (fps[a][1] ^ fps[b][1]).bit_count() <= 12
    want = plain_components([(a, b) for a in ids for b in ids if a < b and near(a, b)], ids)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark, rows)).collect()} == want


def test_pivots_never_discard_a_near_pair():
    refs = simhash.pivots(16)
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, 500).astype(np.uint64)
    y = x ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    gap = np.abs(np.bitwise_count(x[:, None] ^ refs).astype(int) - np.bitwise_count(y[:, None] ^ refs))
    assert gap.max() <= 1


@pytest.mark.parametrize("hubs", [8, 5000])  # only the star's centre, or every node, has its minimum broadcast
def test_components_of_a_chain_and_a_star(spark, monkeypatch, hubs):
    monkeypatch.setattr(components, "HUBS", hubs)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 160)}
    assert {r["node"]: r["component"] for r in found} == want


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    found = simhash.near_duplicate_groups(docs).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1
    assert by_id[4] == 4
    assert simhash.near_duplicate_groups(docs.limit(0)).collect() == []
