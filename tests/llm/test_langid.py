from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import langid

SF = "/root/testdata/sf0.01"


class PlainKneserNey:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, texts, vocabulary):
        grams = Counter()
        for t in texts:
            s = "\x01" * 3 + normal(t)
            grams.update(s[i - 3 : i + 1] for i in range(3, len(s)))
        self.counts = [grams]
        for _ in range(3):
            self.counts.insert(0, Counter(g[1:] for g in self.counts[0]))
        self.discount = []
        for c in self.counts:
            one, two = (sum(1 for v in c.values() if v == k) for k in (1, 2))
            self.discount.append(one / (one + 2 * two) if one and two else 0.5)
        self.totals = [Counter() for _ in range(4)]
        self.kinds = [Counter() for _ in range(4)]
        for k, c in enumerate(self.counts):
            for g, v in c.items():
                self.totals[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1
        self.vocabulary = vocabulary

    def p(self, gram):
        if not gram:
            return 1 / self.vocabulary
        k = len(gram) - 1
        lower = self.p(gram[1:])
        if not self.totals[k][gram[:-1]]:
            return lower
        d, total = self.discount[k], self.totals[k][gram[:-1]]
        return (max(self.counts[k][gram] - d, 0) + d * self.kinds[k][gram[:-1]] * lower) / total

    def nats(self, text):
        s = "\x01" * 3 + normal(text)
        return -np.mean([np.log(self.p(s[i - 3 : i + 1])) for i in range(3, len(s))])


def normal(text):
    out = ""
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or not out.endswith(" "):
            out += c
    return out


def test_entropies_equal_the_plain_model(spark):
    texts = {"aa": ["the cat sat on the mat", "a hat, the rat!", "that 42 cats"], "bb": ["der hund und die katze", "und das haus", "ein hund"]}
    rows = spark.createDataFrame([(g, t) for g, ts in texts.items() for t in ts], "lang string, text string")
    model = langid.fit(rows)
    letters = {c for ts in texts.values() for t in ts for c in normal(t)}
    asked = ["the hund sat", "und that", "die katze 7 quux", "Zebra über"]
    nats, _ = model.entropies(asked)
    for col, lang in enumerate(model.langs):
        plain = PlainKneserNey(texts[lang], len(letters) + 1)
        assert np.allclose(nats[:, col], [plain.nats(t) for t in asked], rtol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1)), F.avg(F.col("rejected").cast("int"))).first()
    assert held[0] > 0.98 and held[1] > 200 and held[2] < 0.01


def test_long_texts_go_in_parts(spark, monkeypatch):
    rows = spark.createDataFrame([("aa", "abc abd abe " * 50), ("bb", "xyz xyw " * 50)], "lang string, text string")
    model = langid.fit(rows)
    whole, n = model.entropies(["abc abd " * 40])
    monkeypatch.setattr(langid, "PART", 64)
    parts, m = model.entropies(["abc abd " * 40])
    assert abs(n - m).max() <= 8 and np.allclose(whole, parts, atol=0.6)


def test_foreign_text_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_on_folds(docs)
    odd = documents(spark, [(1, "жалко что никто не понимает этого языка совсем никак " * 3), (2, "zzqx wvvk qqzj xkcd pqrt zxzx " * 5), (3, docs.where("doc_id = 1").first()["text"])])
    rejected = {r["doc_id"]: r["rejected"] for r in langid.predict(odd, model).collect()}
    assert rejected == {1: True, 2: True, 3: False}


def test_pruned_distributions_sum_to_one(spark, monkeypatch):
    """Discounts are those of all runs; what rare runs had goes to the back-off."""
    rows = spark.createDataFrame([("aa", "abc abd abe acd bad dab " * 50 + " rare words here"), ("bb", "xyz xyw " * 50)], "lang string, text string")
    full = langid.fit(rows)
    monkeypatch.setattr(langid, "KEEP", 4)
    small = langid.fit(rows)
    assert len(small.grams[3].keys) < len(full.grams[3].keys)
    symbols = np.array([ord(c) for c in "abcdehorswxyz "], np.uint64)
    for model in (full, small):
        for lead in ("abc", " ab", "rar", "e a", "zzz"):
            base = sum(np.uint64(ord(c)) << np.uint64(16 * (3 - i)) for i, c in enumerate(lead))
            known = np.exp(model.log_probs(base + symbols)).sum(0) + np.exp(model.log_probs(np.array([base + np.uint64(0x3000)])))[0]
            assert np.allclose(known, 1, atol=1e-4)


def test_without_pruning_every_run_stays(spark, monkeypatch):
    """Where the bound bites, prune=False is the plain model all the same; the pruned one is worse by little."""
    texts = {"aa": ["the cat sat on the mat", "a hat, the rat!", "that 42 cats"] * 3 + ["one rare zebra"], "bb": ["der hund und die katze", "und das haus", "ein hund"] * 2}
    rows = spark.createDataFrame([(g, t) for g, some in texts.items() for t in some], "lang string, text string")
    monkeypatch.setattr(langid, "KEEP", 4)
    whole, pruned = langid.fit(rows, prune=False), langid.fit(rows)
    assert sum(len(t.keys) for t in pruned.grams) < sum(len(t.keys) for t in whole.grams)
    probes = ["the rat sat", "one rare zebra", "das haus"]
    nats = whole.entropies(probes)[0]
    for col, g in enumerate(whole.langs):
        plain = PlainKneserNey(texts[g], len(whole.grams[0].keys) + 1)
        assert np.allclose(nats[:, col], [plain.nats(p) for p in probes], atol=1e-4)


def test_a_model_too_large_for_the_tasks_is_refused(spark):
    rows = spark.createDataFrame([("aa", "the cat sat on the mat"), ("bb", "der hund")], "lang string, text string")
    assert langid.fit(rows, most_bytes=1 << 20)
    with pytest.raises(ValueError, match="bytes"):
        langid.fit(rows, most_bytes=100)


def test_a_rare_language_beside_a_hot_one(spark, monkeypatch):
    """The hot language is pruned by its own volume; the rare one, met once, keeps all its runs and its accuracy."""
    monkeypatch.setattr(langid, "KEEP", 4)
    rare = "xyz wvu qrx zuv"
    hot = [("aa", f"abc abd abe acd {chr(97 + i % 26)}{chr(97 + i // 26)}" * 40) for i in range(260)]
    alone, beside = (langid.fit(spark.createDataFrame(rows, "lang string, text string")) for rows in ([("bb", rare)], [*hot, ("bb", rare)]))
    assert beside.langs == ["aa", "bb"]
    assert set(alone.grams[3].keys) <= set(beside.grams[3].keys)
    every = set(langid.runs([t for _, t in hot])[0])
    assert len(beside.grams[3].keys) < len(every)
    asked = [rare, "xyz zuv", "wvu wvu qrx", "qrx xyz"]
    assert (beside.entropies(asked)[0].argmin(1) == 1).all() and (beside.entropies([t for _, t in hot])[0].argmin(1) == 0).all()


def test_rejection_rates(spark):
    """Held-out texts pass; the same texts with their letters exchanged, which is no language, don't."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit_on_folds(docs)
    held = docs.where((langid.fold_of(F.col("doc_id"), 4) == 2) & (F.length("text") > 40))
    letters = "abcdefghijklmnopqrstuvwxyz"
    strange = held.withColumn("text", F.translate(F.lower("text"), letters, letters[::-1]))
    false, true = (langid.predict(d, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0] for d in (held, strange))
    print("rejected: held-out texts", false, "exchanged letters", true)
    assert false < 0.01 and true > 0.99


def test_clashing_names(spark):
    docs = documents(spark, [(i, "plain words of one language") for i in range(40)])
    for c in ("score", "rejected", "lang_pred", "source_", "c0", "k1"):
        docs = docs.withColumn(c, F.lit(c))
    kept = langid.identified(docs, langid.fit_on_folds(docs))
    assert kept.columns == docs.columns and kept.count() == 40 and kept.first()["score"] == "score"
    told = langid.predict(docs, None, keep=docs.columns)
    assert told.columns.count("score") == 1 and told.where("rejected").count() == 40


def test_odd_rows(spark):
    docs = documents(spark, ODD + [(i, "plain words of one language") for i in range(10, 30)])
    found = langid.identify(docs.withColumn("score", F.lit("x"))).collect()
    assert len(found) == docs.count()
    told = {r["doc_id"]: r for r in found}
    assert told[1]["lang_pred"] == told[2]["lang_pred"] == told[3]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.identify(docs.limit(0)).collect() == []
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_tasks_take_little_memory():
    """Counting and scoring 4 MB of short texts, and the tables another operator left in the worker."""
    import tracemalloc

    import pyarrow as pa

    from marlstone.llm import common, packing

    class Frame:
        def select(self, *_):
            return self

        where = select

        def mapInArrow(self, f, _):
            self.f = f
            raise StopIteration

    frame = Frame()
    with pytest.raises(StopIteration):
        langid.run_counts(frame)
    texts = [prose(i, 40) * 12 for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    packing.encoder("word_bpe_49k.json")
    assert common._kept
    langid.symbols()
    tracemalloc.start()
    found = list(frame.f(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not common._kept and most < 40 << 20
    keys, n = np.unique(langid.runs(texts)[0], return_counts=True)
    whole = {}
    for part in found:
        for k, c in zip(part.column("run").to_pylist(), part.column("n").to_pylist()):
            whole[k] = whole.get(k, 0) + c
    assert whole == dict(zip(keys.view(np.int64).tolist(), n.tolist()))
