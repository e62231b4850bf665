"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of word beginnings, which inflected
forms share. Labelled texts with exchangeable terms are also seen with each term
swapped for every other of its group, and without it, in the form they have and in the
term's other forms (plurals). The squared change of the log-odds between the text and
such a counterfactual, over all features that differ, is penalised, so mentions of a
group carry no weight of their own, and no large bias can hide what they carry.
Exchangeable are identity terms and their plurals, and besides them neutral words of
the training texts: common words whose presence doesn't depend on the label, grouped by
the words they stand beside. The loss is convex; the fit goes on until it is at its
least. The model is fitted on a bounded sample of labelled rows; word counts, contexts,
swaps and scoring are done in parallel.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold_of, labelled_sample, text_slices

Groups = tuple[tuple[str, ...], ...]
WORD = re.compile(r"[^\W\d_]+")
#: Terms of a group are exchangeable in a sentence: one kind of identity, one language.
IDENTITY_GROUPS: Groups = (
    ("women", "men"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrant", "refugee", "citizen", "foreigner"),
    ("old", "young", "elderly", "disabled"),
    ("mujer", "hombre"),
    ("femme", "homme"),
    ("frau", "mann"),
)
#: Plurals that don't end in -s, or are another word; terms that are plurals or have none.
PLURALS = {"jewish": "jews", "mujer": "mujeres", "frau": "frauen", "mann": "männer"}
NO_PLURAL = {"women", "men", "woman", "man", "elderly", "disabled", "old", "young"}


def inflected(groups: Groups) -> Groups:
    """The groups, and the groups of their terms' plurals."""
    plurals = (tuple(PLURALS.get(w, f"{w}s") for w in g if w not in NO_PLURAL) for g in groups)
    return (*groups, *(g for g in plurals if g))


def other_forms(groups: Groups) -> dict[str, str]:
    """Of each term the plural or the singular that groups has of it too, by the place in its group."""
    single = [g for g in groups if any(w not in NO_PLURAL for w in g)]
    out: dict[str, str] = {}
    for g in single:
        for w in g:
            plural = PLURALS.get(w, f"{w}s")
            if w not in NO_PLURAL and any(plural in other for other in groups):
                out[w], out[plural] = plural, w
    return out


#: Beginnings of longer words count as features of their own.
STEMS = (4, 5, 6)


def features(word: str) -> set[str]:
    """A word and its beginnings, with a hyphen."""
    return {word, *(f"{word[:k]}-" for k in STEMS if len(word) > k)}


def words_of(text: str | None) -> set[str]:
    """Words in lower case, and their beginnings with a hyphen."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*([f"{w[:k]}-" for w in words if len(w) > k] for k in STEMS))


def swaps(text: str | None, groups: Groups) -> Iterator[tuple[str, str, set[str], set[str]]]:
    """(term, other, gone, new) for each term of the text and each other term of its group: how the features of the text with other in the term's place differ."""
    words = set(WORD.findall((text or "").lower()))
    there = [(t, g) for g in groups for t in g if t in words]
    if there:
        met = Counter(x for w in words for x in features(w))
        for term, group in there:
            own = {x for x in features(term) if met[x] == 1}
            for other in group:
                if other != term:
                    others = features(other)
                    yield term, other, own - others, {x for x in others if x not in met}


def counterfactuals(text: str | None, groups: Groups, forms: dict[str, str]) -> Iterator[tuple[set[str], set[str]]]:
    """(gone, new) features of each counterfactual: swaps, and the text without the term; both also for the text with the term's other form in its place."""
    words = set(WORD.findall((text or "").lower()))
    terms = {t for g in groups for t in g}
    for term in sorted(words & terms):
        for form in {term, forms.get(term, term)}:
            rest = words - {term, form}
            kept = {x for w in rest for x in features(w)}
            own = features(form) - kept
            yield own, set()
            for g in groups:
                if form in g:
                    for other in g:
                        if other != form:
                            others = features(other) - kept
                            yield own - others, others - own


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    pairs: int = 0  # text and counterfactual, as many as the fit penalised
    converged: bool = True

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.bias + math.fsum(w[x] for x in words_of(text) & w.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _bags(rows: DataFrame) -> DataFrame:
    """(label, words): the features of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            bags = [sorted(words_of(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(bags, pa.list_(pa.string()))], ["label", "words"])

    return rows.select("label", "text").mapInArrow(run, "label int, words array<string>")


def neutral_groups(rows: DataFrame, words: list[str], alike: float = 0.5, size: int = 3) -> Groups:
    """Groups of at most `size` of these words that stand beside the same ones of them, by cosine."""
    index = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for part in text_slices(batches):
            for text in part.column("text").to_pylist():
                ids = [index.get(w, -1) for w in WORD.findall((text or "").lower())]
                met.update((a, b) for a, b in zip(ids, ids[1:]) if a >= 0 and b >= 0)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*met)] + [pa.array(list(met.values()), pa.int64())], ["a", "b", "n"])

    beside = np.zeros((len(words), len(words)))
    for r in rows.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # the words' number squared, at most
        beside[r["a"], r["b"]] = r["n"]
    context = np.sqrt(np.c_[beside, beside.T])
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-9
    near = np.triu(context @ context.T, 1)
    groups = {i: [i] for i in range(len(words))}
    for flat in np.argsort(-near, axis=None, kind="stable"):
        a, b = divmod(int(flat), len(words))
        if near[a, b] < alike:
            break
        one, two = groups[a], groups[b]
        if one is not two and len(one) + len(two) <= size:
            one += two
            groups.update(dict.fromkeys(two, one))
    found = {id(g): tuple(words[i] for i in g) for g in groups.values() if len(g) > 1}
    return tuple(sorted(found.values()))


def _coded(rows: DataFrame, index: dict[str, int], groups: list[Groups]) -> DataFrame:
    """(label, ids, swaps): the model's features of a text, and the kind (which of groups) and the signed differences of each of its counterfactuals. Features count from 1 in these, gone ones are negative."""

    forms = [other_forms(some) for some in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            ids, told = [], []
            for text in part.column("text").to_pylist():
                ids.append(sorted(index[x] for x in words_of(text) & index.keys()))
                own = []
                for kind, some in enumerate(groups):
                    for gone, new in counterfactuals(text, some, forms[kind]):
                        change = [*sorted(-1 - index[x] for x in gone & index.keys()), *sorted(1 + index[x] for x in new & index.keys())]
                        if change:
                            own.append([kind, *change])
                told.append(own)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(told, pa.list_(pa.list_(pa.int32())))], ["label", "ids", "swaps"])

    return rows.select("label", "text").mapInArrow(run, "label int, ids array<int>, swaps array<array<int>>")


def _flat(bags: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature."""
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return rows, np.concatenate([np.array(b, np.int64) for b in bags]) if len(rows) else np.zeros(0, np.int64)


def train(bags: list[list[int]], labels: np.ndarray, size: int, swapped: list[list[list[int]]], penalty: float, ridge: float = 1e-4, steps: int = 3000, close: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Weights, bias, and whether they are at the least loss: accelerated full-batch gradient descent, begun anew where it overshoots.

    swapped has, for each bag, (kind, differences...) of its counterfactuals as _coded
    gives them. The penalty is on the squared change of the log-odds, its mean over the
    counterfactuals of each kind. It ends when no weight would move by `close`.
    """
    rows, cols = _flat(bags)
    kinds = Counter(tuple(c) for s in swapped for c in s)  # log-odds change by the same, whatever the text
    rows2, signed = _flat([list(c[1:]) for c in kinds])
    cols2, sign = np.abs(signed) - 1, np.sign(signed).astype(float)
    n, w, bias = len(bags), np.zeros(size), 0.0
    hot = labels.sum()
    cost = np.where(labels == 1, n / (2 * hot), n / (2 * (n - hot)))  # both labels count the same in all
    width = cost * (np.bincount(rows, minlength=n) + 1.0)
    group = np.array([c[0] for c in kinds], np.int64)
    share = np.array(list(kinds.values()), float)
    if len(share):
        share *= penalty / np.bincount(group, share)[group]
    # each weight's own step: the curvature is at most this diagonal
    wide = np.bincount(rows2, minlength=len(kinds)) * share if len(share) else share
    curve = np.bincount(cols2, 2 * wide[rows2], size) if len(share) else 0.0
    rate = 1 / (0.25 * np.bincount(cols, width[rows], size) / n + ridge + curve)
    bias_rate = 1 / (0.25 * width.mean())
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(steps):
        z = np.bincount(rows, ahead[cols], n) + ahead_bias
        miss = cost * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n
        grad = np.bincount(cols, miss[rows], size) + ridge * ahead
        if len(share):
            moved = np.bincount(rows2, sign * ahead[cols2], len(kinds))
            grad += np.bincount(cols2, sign * (2 * share * moved)[rows2], size)
        move, move_bias = rate * grad, bias_rate * miss.sum()
        new, new_bias = ahead - move, ahead_bias - move_bias
        if max(np.abs(move).max(initial=0.0), abs(move_bias)) < close:
            return new, float(new_bias), True
        if grad @ (new - w) + miss.sum() * (new_bias - bias) > 0:
            t = 1.0  # uphill
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, float(bias), False


def fit(rows: DataFrame, vocabulary: int = 2048, penalty: float = 10.0, groups: Groups = IDENTITY_GROUPS, neutral: int = 64) -> Model:
    """Learn from a bounded sample of (doc_id, text, label).

    The features are the words whose presence differs most between labels by the
    chi-square statistic, at most `vocabulary`, and the exchangeable terms: the groups'
    and their plurals, and those grouped among `neutral` words of the 512 commonest
    whose presence doesn't depend on it (chi-square of 10.83 at most, p 0.001): those
    whose label rates differ most by chance, as a fit without the penalty would learn them.
    """
    rows = rows.where("label is not null").persist()
    bags = _bags(rows)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("hot")).first()
    n, hot = total["n"], total["hot"]
    if not hot or hot == n:
        rows.unpersist()
        return Model({}, float(np.log((hot + 0.5) / (n - hot + 0.5))))
    a, both = F.col("hot").cast("double"), F.col("n").cast("double")
    odds = a * F.lit(float(n)) - both * F.lit(float(hot))
    chi = odds * odds * F.lit(float(n)) / (both * (F.lit(float(n)) - both + F.lit(1e-9)) * F.lit(float(hot)) * F.lit(float(n - hot)))
    counts = bags.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hot"))
    counts = counts.where("n >= 3").select("word", "n", chi.alias("chi")).persist()
    words = [r["word"] for r in counts.where("chi > 15").orderBy(F.desc("chi"), "word").limit(vocabulary).collect()]
    common = counts.where("chi <= 10.83 and not word like '%-'").orderBy(F.desc("n"), "word").limit(512)
    plain = common.orderBy(F.desc("chi"), "word").limit(neutral).collect()
    counts.unpersist()
    alike = [inflected(groups), neutral_groups(rows, [r["word"] for r in plain])]
    words = list(dict.fromkeys([*words, *(w for some in alike for g in some for w in g)]))
    sets = _coded(rows, {w: i for i, w in enumerate(words)}, alike).collect()  # bounded by the sample, the vocabulary and the groups
    rows.unpersist()
    swapped = [r["swaps"] for r in sets]
    w, bias, converged = train([r["ids"] for r in sets], np.array([r["label"] for r in sets], float), len(words), swapped, penalty)
    return Model(dict(zip(words, w.tolist())), bias, sum(map(len, swapped)), converged)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts get the score of no word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches):
            scores = [m.score(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, max_rows: int = 20_000, vocabulary: int = 2048, penalty: float = 10.0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels of the held-out fold are never read. Labels that are null or lack a document
    teach nothing; of several labels of one document the higher counts. Rows with a
    null id are scored and belong to no fold; repeated rows are each scored. Without
    labels of both kinds every score is the share of label 1. Empty tables give an
    empty result.
    """
    known = labels.where((fold_of(F.col("doc_id"), folds) != held_out) & F.col("toxic").isNotNull())
    marks = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    model = fit(labelled_sample(docs, marks, max_rows), vocabulary, penalty)
    held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
