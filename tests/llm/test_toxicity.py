import numpy as np
from pyspark.sql import functions as F

from helpers import ODD, documents, prose
from marlstone.llm import toxicity

SF = "/root/testdata/sf0.1"


def auc(p, y):
    rank = np.argsort(np.argsort(p, kind="stable"), kind="stable")
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    p, y, hard = (np.array(x) for x in zip(*rows))
    assert auc(p, y) > 0.95
    assert hard[y == 0].mean() < 0.01 and hard[y == 1].mean() > 0.8


def mentions(spark):
    """Insults are toxic; so are most texts that mention a group, though the mention isn't."""
    rows, labels = [], []
    for i in range(600):
        insult, group = i % 4 == 0, (i % 4 == 0 and i % 8 == 0) or i % 40 == 1
        rows.append((i, prose(i, 30) + (" vilified" if insult else "") + (" women" if group else "")))
        labels.append((i, int(insult)))
    return documents(spark, rows).select("doc_id", "text").join(spark.createDataFrame(labels, "doc_id long, label int"), "doc_id")


def test_penalty_takes_weight_off_group_terms(spark):
    rows = mentions(spark)
    free, bound = (toxicity.fit(rows, penalty=p) for p in (0.0, 20.0))
    gap = [abs(m.weights["women"] - m.weights["men"]) for m in (free, bound)]
    assert gap[1] < 0.5 * gap[0]
    assert bound.score("all of them vilified") > 0.7 > bound.score("women and men of the town")


def test_penalty_holds_for_stems_and_plurals(spark):
    """What a neutral mention of a group adds goes away, whichever of its features learnt it."""
    rows = []
    for i in range(600):
        group, insult = i % 4 == 0, i % 10 == 1
        rows.append((i, prose(i, 30) + (" vilified" if insult else "") + (" muslims" if group else ""), int(insult or (group and i % 5 > 0))))
    rows = spark.createDataFrame(rows, "doc_id long, text string, label int")
    free, bound = (toxicity.fit(rows, penalty=p) for p in (0.0, 20.0))
    gap = [abs(m.score("the muslims of the town") - m.score("the christians of the town")) for m in (free, bound)]
    assert gap[0] > 0.3 and gap[1] < 0.25 * gap[0]


def test_no_bias_hides_what_a_mention_adds(spark):
    """Texts of one group are toxic and those of others aren't; plurals aren't in the sample. Unpenalised scores are far apart."""
    rows = []
    for i in range(300):
        term = ("muslim", "christian", "hindu")[i % 3]
        rows.append((i, f"the {term} {prose(i, 6)} home", int(term == "muslim")))
    rows += [(1000 + i, f"the walk {prose(1000 + i, 6)} home", int(i % 10 == 0)) for i in range(60)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, label int")
    texts = ["the walk home", "the muslims walk home", "the muslim walk home", "the christians walk home", "the hindus walk home", "muslim", "christian", "muslims"]
    free, bound = (toxicity.fit(rows, penalty=p, neutral=0) for p in (0.0, 100.0))
    scores = [[m.score(t) for t in texts] for m in (free, bound)]
    assert bound.converged and max(scores[0]) - min(scores[0]) > 0.5 and max(scores[1]) - min(scores[1]) < 0.1


def test_counterfactuals_are_those_of_the_changed_text():
    groups = toxicity.inflected(toxicity.IDENTITY_GROUPS)
    forms = toxicity.other_forms(groups)
    assert forms["muslim"] == "muslims" and forms["jews"] == "jewish" and "women" not in forms
    text = "a muslim met muslin traders and old men"
    words = lambda t: toxicity.words_of(t)
    want = set()
    for term in ("muslim", "old", "men"):
        for form in {term, forms.get(term, term)}:
            base = text.replace(term, form)
            for other in ["", *(o for g in groups if form in g for o in g if o != form)]:
                changed = base.replace(form, other)
                want.add((frozenset(words(base) - words(changed)), frozenset(words(changed) - words(base))))
    assert {(frozenset(a), frozenset(b)) for a, b in toxicity.counterfactuals(text, groups, forms)} == want
    assert list(toxicity.counterfactuals(None, groups, forms)) == []


def test_swaps_are_those_of_the_swapped_text():
    """Differences equal those between the features of the text and of the text with the other word in its place."""
    groups = toxicity.inflected(toxicity.IDENTITY_GROUPS)
    texts = ["The Muslims met a muslim and muslin traders", "women and men; womenfolk", "old", "", None, "christian christians christianity", "gay black frauen"]
    for text in texts:
        seen = 0
        for term, other, gone, new in toxicity.swaps(text, groups):
            before, after = toxicity.words_of(text), toxicity.words_of(toxicity.re.sub(rf"\b{term}\b", other, text.lower()))
            assert gone == before - after and new == after - before
            seen += 1
        words = set(toxicity.WORD.findall((text or "").lower()))
        assert seen == sum(len(g) - 1 for g in groups for t in g if t in words)


def test_gradient_is_right():
    """The accelerated descent ends, and says so, where the loss is flat."""
    r = np.random.default_rng(3)
    bags = [sorted(r.choice(8, 3, replace=False).tolist()) for _ in range(60)]
    y = np.array([float(0 in b or r.random() < 0.2) for b in bags])
    swapped = [[[0, -1 - a, *([1 + c] if c not in b else [])] for a, c in ((5, 6), (6, 5)) if a in b] for b in bags]
    w, b, converged = toxicity.train(bags, y, 8, swapped, penalty=2.0, ridge=0.01, close=1e-7)
    assert converged and not toxicity.train(bags, y, 8, swapped, penalty=2.0, steps=3)[2]

    def loss(w, b):
        x = np.array([[i in bag for i in range(8)] for bag in bags], float)
        p = 1 / (1 + np.exp(-(x @ w + b)))
        cost = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        out = -(cost * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() + 0.005 * (w**2).sum()
        diffs = []
        for row in x:
            for a, c in ((5, 6), (6, 5)):
                if row[a]:
                    other = row.copy()
                    other[a], other[c] = 0, 1
                    diffs.append((row @ w - other @ w) ** 2)
        return out + 2.0 * np.mean(diffs)

    at = loss(w, b)
    for k in range(8):
        for step in (1e-3, -1e-3):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, b) > at - 2e-6


def test_scores_equal_a_plain_version(spark):
    """Scoring is the model's weights over the words and beginnings of each whole text."""
    model = toxicity.Model({"idiot": 2.0, "idio-": 0.5, "kind": -1.0}, -0.25)
    rows = [(1, "Idiot! kind"), (2, "idiots"), (3, None), (4, "x " * 50_000 + "IDIOT")]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, rows), model).collect()}
    want = {1: 2.0 + 0.5 - 1.0 - 0.25, 2: 0.5 - 0.25, 3: -0.25, 4: 2.5 - 0.25}
    assert all(abs(found[i] - 1 / (1 + np.exp(-z))) < 1e-12 for i, z in want.items())


def swap_gap(spark, penalties):
    """Mean change of the held-out texts' log-odds when a neutral word is swapped, for models of these penalties, and their AUC."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))
    held = toxicity.fold_of(F.col("doc_id"), 3) == 1
    groups, out = [], []
    keep = toxicity.neutral_groups
    toxicity.neutral_groups = lambda *a, **b: groups.append(keep(*a, **b)) or groups[-1]
    try:
        models = [toxicity.fit(rows.where(~held), penalty=p) for p in penalties]
    finally:
        toxicity.neutral_groups = keep
    assert groups[0] == groups[1] and all(1 < len(g) <= 3 for g in groups[0])
    texts = rows.where(held).select("text", "label").collect()
    for m in models:
        w = m.weights
        gaps = [abs(sum(w.get(x, 0) for x in new) - sum(w.get(x, 0) for x in gone)) for t in texts[:300] for gone, new in toxicity.counterfactuals(t["text"], groups[0], {})]
        out.append((float(np.mean(gaps)), float(auc(np.array([m.score(t["text"]) for t in texts]), np.array([t["label"] for t in texts]))), m))
    return out


def test_the_corpus_own_swaps_move_the_score_less(spark):
    """Without identity terms in the corpus its neutral words take part: the penalty more than halves what swapping them does, and costs no accuracy."""
    (free, free_auc, a), (bound, bound_auc, b) = swap_gap(spark, (0.0, 10.0))
    print("swap gap", free, bound, "AUC", free_auc, bound_auc)
    assert a.pairs == b.pairs > 1000 and a.converged and b.converged
    assert bound < 0.5 * free and bound_auc > 0.95 and bound_auc > free_auc - 0.005


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("label", F.lit("x")).withColumn("words", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (77, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.classify(docs, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)
    assert len(toxicity.classify(docs, labels.limit(0)).collect()) == len(ODD)
    assert toxicity.classify(docs.limit(0), labels).collect() == []
