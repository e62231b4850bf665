import random

import numpy as np
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import decontam


def plain_tiles(doc, item, least):
    """Greedy string tiling by comparing everything with everything."""
    used_d, used_i, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not used_i[i + n] and not used_d[d + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, d)]
                elif n == best and n >= least:
                    found.append((i, d))
        if not found:
            return tiles
        for i, d in found:
            if not any(used_i[i : i + best]) and not any(used_d[d : d + best]):
                used_i[i : i + best] = [True] * best
                used_d[d : d + best] = [True] * best
                tiles.append((i, d, best))


def test_tiling_equals_the_plain_one():
    r = random.Random(5)
    for _ in range(40):
        item = [r.randint(1, 9) for _ in range(r.randint(3, 25))]
        doc = [r.randint(1, 9) for _ in range(r.randint(3, 40))]
        at = r.randint(0, len(doc))
        doc[at:at] = item[len(item) // 2 :] + [77] + item[: len(item) // 2]
        got = decontam.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        want = plain_tiles(doc, item, 3)
        assert sorted(t[2] for t in got) == sorted(t[2] for t in want)
        assert all(doc[d : d + n] == item[i : i + n] for i, d, n in got)


def planted(spark):
    items = [(i, prose(1000 + i, 30)) for i in range(20)] + [(50, "tiny item"), (51, ""), (52, None), (53, prose(1000, 30))]
    words = [t.split() if t else [] for _, t in items]
    rows = [(i, prose(i, 80)) for i in range(60)]
    rows += [(100, prose(100, 40) + " " + items[3][1].upper() + " " + prose(101, 40))]
    rows += [(101, prose(102, 10) + " " + " ".join(words[4][15:]) + " between them " + " ".join(words[4][:15]))]
    rows += [(102, " ".join(words[5][:20]) + " " + prose(103, 50))]
    rows += [(103, "has a tiny, item in it"), (104, "tiny other item")]
    rows += [(105, " ".join(words[6][:14]) + " swapped " + " ".join(words[6][15:]))]
    return documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), rows, items


def test_planted_passages_are_found(spark):
    docs, bench, rows, items = planted(spark)
    found = decontam.contaminated(docs, bench).collect()
    want = set()
    for d, t in rows:
        for i, u in items:
            doc, item = decontam.tokens(t).tolist(), decontam.tokens(u).tolist()
            if item and sum(x[2] for x in plain_tiles(doc, item, min(5, len(item)))) >= 0.8 * len(item):
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert {(100, 3), (101, 4), (103, 50), (105, 6)} <= want and not {d for d, _ in want} & set(range(60)) and 102 not in {d for d, _ in want}
    moved = next(r for r in found if r["doc_id"] == 101)
    assert moved["tiles"] == 2 and moved["coverage"] == 1.0


def test_odd_rows(spark):
    docs, bench, _, _ = planted(spark)
    odd = documents(spark, ODD).withColumn("row", F.lit(1)).withColumn("item_id", F.lit(2))
    items = spark.createDataFrame([(1, "A, B c! d e f g h")], "item_id long, text string")
    found = decontam.contaminated(odd, items).collect()
    assert sorted((r["doc_id"] or 0) for r in found) == [0, 4, 4]
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []


def test_equals_all_pairs(spark):
    """Every document against every item, by the plain tiling: items that share a passage, parts in another order, parts left out."""
    common = prose(900, 12)
    items = [(k, f"{prose(500 + k, 12 + k)} {common} {prose(600 + k, 8)}") for k in range(12)] + [(50, "short one"), (51, common), (52, prose(700, 4))]
    rows = []
    for i in range(90):
        words = items[i % 12][1].split()
        cut = i % len(words)
        moved = words[cut:] + words[:cut]
        rows.append((i, f"{prose(i, 30)} {' '.join(moved[: len(moved) - i // 12])} {common if i % 3 else 'short one'} {prose(2000 + i, 20)}"))
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, text in rows:
        for k, item in items:
            a, b = decontam.tokens(text), decontam.tokens(item)
            covered = sum(n for _, _, n in decontam.tile(a, b, min(5, len(b))))
            if covered >= 0.8 * len(b):
                want[d, k] = covered
    found = {(r["doc_id"], r["item_id"]): r["covered_tokens"] for r in decontam.contaminated(docs, bench).collect()}
    assert found == want and len({k for _, k in want}) > 8
