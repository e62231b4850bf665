import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import quality_rules

SF = "/root/testdata/sf0.001"


def plain_base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def js(p, q):
    def part(x, y):
        return x * math.log2(2 * x / (x + y)) if x > 0 else 0

    return sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2


def classes(text):
    groups = [re.findall(x, text) for x in ("[A-Z]", "[0-9]", r"[.,;:?!'\"()-]", r"[#*$%&|<>]")]
    accent = sum(c > "\x7f" for c in text)
    known = [*map(len, groups), accent]
    return [*known, max(0, sum(1 for c in text if c not in " \t\n\x0b\f\r") - sum(known))]


def plain_words(text):
    return re.sub(r"[.,;:?!'\"()\-#*$%&|<> \t\n\x0b\f\r]", " ", text.lower()).split(" ")


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.collect(), {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}


def test_base_counts(judged):
    docs, found = judged
    for d in docs:
        counts, failed = plain_base(d["text"])
        r = found[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_divergences(judged):
    docs, found = judged
    by_lang = {}
    for d in docs:
        by_lang.setdefault(d["lang"], []).append(d["text"])
    for lang, texts in by_lang.items():
        sums = [sum(x) for x in zip(*map(classes, texts))]
        usual = [x / sum(sums) for x in sums]
        counts = Counter(w for t in texts for w in plain_words(t) if w)
        top = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:32]]
        n_words = sum(plain_base(t)[0][0] for t in texts)
        share = [counts[w] / n_words for w in top]
        for d in (d for d in docs if d["lang"] == lang):
            own = classes(d["text"])
            r = found[d["doc_id"]]
            assert r["class_divergence"] == pytest.approx(js([x / max(1, sum(own)) for x in own], usual), abs=1e-9)
            mine = Counter(plain_words(d["text"]))
            p = [mine[w] / max(1, r["n_words"]) for w in top]
            rest = [max(0, 1 - sum(x)) for x in (p, share)]
            assert r["word_divergence"] == pytest.approx(js([*p, rest[0]], [*share, rest[1]]), abs=1e-9)


def test_characters_are_counted_not_bytes(spark):
    text = "漢字 \U0001f600\U0001f600 é_~ Ab1#."
    row = quality_rules.base_counts(documents(spark, [(1, text)])).first()
    assert [row[c] for c in quality_rules.CLASS_COLUMNS] == [1, 1, 1, 1, 5, 3] == [*classes(text)]


def test_common_words_of_any_length_in_any_case(spark):
    docs = documents(spark, [(i, f"ÉTRANGEMENT étrangement the {prose(i, 5)}", "fr") for i in range(9)])
    assert quality_rules.word_references(docs, 2) == {"fr": ["étrangement", "the"], "": ["étrangement", "the"]}


def test_strange_texts_go_and_plain_ones_stay(spark):
    rows = [(i, prose(i, 200).replace("ba", "the of and")) for i in range(60)]
    rows += [(100, " ".join(w + "%%%" for w in prose(100, 200).replace("ba", "the of and").split())), (101, "%%% ### " * 5)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert not kept[100] and not kept[101] and all(kept[i] for i in range(60))


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, (7, "x y z " * 50, None), (8, prose(8, 80), "xx")]).withColumn("common", F.lit(1)).withColumn("reference", F.lit(2))
    found = quality_rules.judge(docs).collect()
    assert len(found) == docs.count()
    assert all(r["kept"] is not None and r["base_failed"] is not None for r in found)
    assert next(r for r in found if r["doc_id"] == 6)["n_repeat_words"] == 30000
    assert quality_rules.judge(docs.limit(0)).collect() == []
