"""Language identification by interpolated Kneser-Ney character models.

Counts of four-character runs per language come from all rows given to learn from, and
from all of these counts, in parallel, the continuation counts of the shorter runs, the
discounts and the totals of the contexts. Of each language the runs that aren't rare
for its volume make the model; what the others had goes to their contexts' back-off
weights, so the distributions still sum to one. The model has, for each order, one
sorted array of the runs' 64-bit keys over all languages, and a row of
log-probabilities, one per language, so a run is looked up once for all of them. A text
gets the language of the lowest cross-entropy per character. Calibration rows, which
counting doesn't see, give quantiles of the cross-entropy of each language and length;
what exceeds them by far is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold_of, let_go, text_slices

ORDER = 4
START = 1
BLANK = 32
UNDETERMINED = "und"
#: Texts go through in parts of so many characters.
PART = 1 << 20
#: Bytes of text, and runs, that a task works on at a time: each takes some 50 bytes more meanwhile.
SLICE = 1 << 18
#: A language keeps runs that are met at least the square root of its volume, by this, times.
KEEP = 1 << 12
#: Bytes of the runs of one order that may go to the driver and to every task.
MODEL_BYTES = 256 << 20
MASKS = [np.uint64((1 << (16 * n)) - 1) for n in range(ORDER + 1)]
SIXTEEN = np.uint64(16)


@cache
def symbols() -> np.ndarray:
    """16-bit symbol of each code point: letters and marks in lower case, all else a blank."""
    out = np.full(0x110000, BLANK, np.uint64)
    for cp in range(0x30000):
        if unicodedata.category(c := chr(cp))[0] in "LM":
            low = ord(c.lower()[0])
            out[cp] = low if low < 0x10000 else 0xE000 + low % 0x1900
    return out


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the four-symbol runs of all texts, and the index of the text of each. A text starts with START symbols."""
    parts = [(i, t[a : a + PART]) for i, t in enumerate(texts) for a in range(0, len(t), PART)]
    lead = chr(START) * (ORDER - 1)
    points = np.frombuffer((lead + lead.join(p for _, p in parts)).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(p) for _, p in parts], np.int64)
    owner = np.repeat(np.array([i for i, _ in parts], np.int32), lengths + ORDER - 1)
    first = np.r_[0, np.cumsum(lengths + ORDER - 1)][:-1]
    sym = symbols()[points]
    for k in range(ORDER - 1):
        sym[first + k] = START
    keep = (sym != BLANK) | np.r_[True, sym[:-1] != BLANK]
    sym, owner = sym[keep], owner[keep]
    if len(sym) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys = (sym[:-3] << np.uint64(48)) | (sym[1:-2] << np.uint64(32)) | (sym[2:-1] << SIXTEEN) | sym[3:]
    scored = sym[3:] != START
    return keys[scored], owner[3:][scored]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def run_counts(rows: DataFrame) -> DataFrame:
    """(lang, run, n) over all rows of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: dict[str, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "run", "n"])
            held.clear()

        for part in text_slices(batches, size=SLICE):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                keys, n = np.unique(runs(texts)[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((keys, n))
                if sum(len(k) for k, _ in parts[1:]) > max(SLICE, len(parts[0][0])):
                    parts[:] = [_merged(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > 4_000_000:
                yield from out()
        yield from out()

    rows = rows.select("lang", "text").where("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Sorted keys and a row of values, one per language."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)


@dataclass
class Model:
    langs: list[str]
    grams: list[Table]  # by order, from 1
    backoff: list[Table]  # log weights of the next lower order, by order, from 1; keys are contexts
    unknown: np.ndarray  # of a symbol never met
    expected: dict[str, tuple[float, list[float]]] | None = None  # median cross-entropy, and the most to accept by length class

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row per run, a column per language."""
        if not order:
            return np.broadcast_to(self.unknown, (len(keys), len(self.langs)))
        table = self.grams[order - 1]
        at, met = table.find(keys & MASKS[order])
        out = table.values[at] if len(table.keys) else np.zeros((len(keys), len(self.langs)), np.float32)
        if not met.all():
            rest = keys[~met]
            lower = self.log_probs(rest, order - 1)
            if order > 1:
                contexts = self.backoff[order - 1]
                at, met_context = contexts.find((rest & MASKS[order]) >> SIXTEEN)
                lower = lower + np.where(met_context[:, None], contexts.values[at], 0)
            out[~met] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of every text under every language, and the number of symbols."""
        keys, owner = runs(texts)
        n = np.bincount(owner, minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(keys), SLICE):
            logs = self.log_probs(keys[a : a + SLICE])
            own = owner[a : a + SLICE]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[starts]] -= np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        return total / np.maximum(n, 1)[:, None], n


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), 15)


@dataclass
class Counts:
    """Of one language and order: kept runs, sorted, with their counts and what their contexts have."""

    keys: np.ndarray
    n: np.ndarray
    discount: float
    contexts: np.ndarray
    total: np.ndarray
    left: np.ndarray  # the share of a context's mass that the order below gets


def kneser_ney(langs: list[str], counts: dict[str, list[Counts]]) -> Model:
    """counts: of each language by order, from 1."""
    union = [np.unique(np.concatenate([counts[g][k].keys for g in langs])) for k in range(ORDER)]
    contexts = [np.unique(np.concatenate([counts[g][k].contexts for g in langs])) for k in range(ORDER)]
    vocabulary = len(union[0]) + 1
    grams = [np.zeros((len(u), len(langs)), np.float32) for u in union]
    weights = [np.zeros((len(c), len(langs)), np.float32) for c in contexts]
    unknown = np.zeros(len(langs), np.float32)
    for col, lang in enumerate(langs):
        shares: list[np.ndarray] = []  # of the orders so far, over their unions

        def share(keys: np.ndarray, order: int) -> np.ndarray:
            """Probabilities of runs of an order that is done, in the model or not."""
            if not order:
                return np.full(len(keys), 1 / vocabulary)
            at = np.minimum(np.searchsorted(union[order - 1], keys), len(union[order - 1]) - 1)
            out = shares[order - 1][at]
            rest = np.flatnonzero(union[order - 1][at] != keys)
            if len(rest):
                _, left = of_context(keys[rest], counts[lang][order - 1])
                out[rest] = left * share(keys[rest] & MASKS[order - 1], order - 1)
            return out

        def of_context(keys: np.ndarray, own: Counts) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(own.contexts, keys >> SIXTEEN), len(own.contexts) - 1)
            met = own.contexts[at] == keys >> SIXTEEN
            return np.where(met, own.total[at], np.inf), np.where(met, own.left[at], 1.0)

        for k, own in enumerate(counts[lang]):
            count = np.zeros(len(union[k]))
            count[np.searchsorted(union[k], own.keys)] = np.maximum(own.n - own.discount, 0)
            total, left = of_context(union[k], own)
            shares.append(count / total + left * share(union[k] & MASKS[k], k))
            grams[k][:, col] = np.log(shares[k])
            weights[k][np.searchsorted(contexts[k], own.contexts), col] = np.log(own.left)
        unknown[col] = weights[0][0, col] - np.log(vocabulary)
    return Model(langs, [Table(*x) for x in zip(union, grams)], [Table(*x) for x in zip(contexts, weights)], unknown)


def _by_lang(found: pd.DataFrame) -> dict[str, list[np.ndarray]]:
    """Sorted keys of each language, and its other columns in their order."""
    out = {}
    for lang, own in found.groupby("lang"):
        keys = own["run"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        out[lang] = [keys[order], *(own[c].to_numpy()[order] for c in own.columns[2:])]
    return out


def fit(rows: DataFrame, prune: bool = True, most_bytes: int = MODEL_BYTES) -> Model | None:
    """Learn from (lang, text). Every row is counted; a language's own volume tells which of its runs make the model.

    Discounts, continuation counts and totals are those of all runs. A run stays in the
    model if its count is at least a 4096th of the square root of all counts of its
    language, so a language of up to 2^24 characters keeps all, and what a larger one
    keeps grows with it. Hot languages take nothing from rare ones, and a language's
    commonest run stays. Without prune every run stays. None if there is nothing to
    learn from. The model goes through the driver to every task: one of more than
    most_bytes is refused before it is gathered, as its size follows the different runs
    and not the rows.
    """
    orders = [run_counts(rows).persist()]
    for order in range(ORDER - 1, 0, -1):  # distinct predecessors of the shorter runs
        shorter = orders[0].select("lang", F.col("run").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("run"))
        orders.insert(0, shorter.groupBy("lang", "run").agg(F.count(F.lit(1)).alias("n")).persist())
    found: dict[str, list[Counts]] = {}
    for counted in orders:
        told = counted.groupBy("lang").agg(F.sum("n").alias("volume"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()  # a row a language
        discount = {r["lang"]: r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] and r["twice"] else 0.5 for r in told}
        bounds = [(r["lang"], min(r["most"], int(r["volume"] ** 0.5 / KEEP)) if prune else 0, discount[r["lang"]]) for r in told]
        if not bounds:
            break
        known = counted.join(F.broadcast(counted.sparkSession.createDataFrame(bounds, "lang string, least long, discount double")), "lang")
        kept = F.col("n") >= F.col("least")
        size = known.where(kept).agg(F.count_distinct("run")).first()[0] * (8 + 4 * len(bounds))
        if size > most_bytes:
            raise ValueError(f"the model would have {size} bytes of runs of order {len(found[bounds[0][0]]) + 1 if found else 1}; raise most_bytes or prune")
        grams = known.where(kept).select("lang", "run", "n").toPandas()
        context = F.shiftrightunsigned("run", 16).alias("run")
        sums = known.groupBy("lang", context).agg(F.sum("n").alias("total"), F.sum(F.when(kept, F.col("n") - F.col("discount"))).alias("mass"))
        sums = sums.where("mass is not null").select("lang", "run", "total", (1 - F.col("mass") / F.col("total")).alias("left")).toPandas()  # no more rows than grams
        contexts = _by_lang(sums)
        for lang, (keys, n) in _by_lang(grams).items():
            found.setdefault(lang, []).append(Counts(keys, n, discount[lang], *contexts[lang]))
    for counted in orders:
        counted.unpersist()
    return kneser_ney(sorted(found), found) if found else None


def calibrate(model: Model, rows: DataFrame, quantile: float = 0.995, times: float = 2.0, floor: float = 0.25, enough: int = 200) -> None:
    """Set the cross-entropy to accept of each language by length, from (lang, text) that the counts didn't see.

    A text is accepted up to its language's median and `times` the `quantile` of the
    excess over it, floor nats at least, among calibration texts of its language and
    length class; among those of its length in any language where these are fewer than
    `enough`, or else among all.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        for part in text_slices(batches, size=SLICE):
            langs = part.column("lang").to_pylist()
            bits, n = m.entropies(part.column("text").to_pylist())
            rows = [(g, int(c), float(bits[i, m.langs.index(g)])) for i, (g, c) in enumerate(zip(langs, length_class(n))) if n[i] and g in m.langs]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["lang", "class", "entropy"])

    found = rows.select("lang", "text").where("lang is not null and text is not null").mapInArrow(own, "lang string, class long, entropy double").persist()
    medians = {r["lang"]: r["m"] for r in found.groupBy("lang").agg(F.percentile_approx("entropy", 0.5, 10_000).alias("m")).collect()}  # a row a language
    model.expected = {}
    if medians:
        centre = F.create_map(*(F.lit(x) for pair in medians.items() for x in pair))
        excess = found.select("lang", "class", (F.col("entropy") - F.element_at(centre, F.col("lang"))).alias("excess"))
        cube = excess.cube("lang", "class").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("excess", quantile, 10_000).alias("q")).collect()  # 17 rows a language, and 17
        by = {(r["lang"], r["class"]): r["q"] for r in cube if r["n"] >= enough or (r["lang"] is None and r["class"] is None)}
        for lang, median in medians.items():
            bound = (by.get((lang, c), by.get((None, c), by[None, None])) for c in range(16))
            model.expected[lang] = (median, [median + max(floor, times * q) for q in bound])
    found.unpersist()


def predict(docs: DataFrame, model: Model | None, accept: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (its id by default), lang_pred, score and rejected for every row.

    score is the language's share among all languages by likelihood over at most 32
    symbols, times how well the text's cross-entropy agrees with what is expected.
    Null texts and those without a letter, or all where there is no model, are `und`
    with score 0 and rejected. Kept columns of the result's names are replaced.
    """
    keep = [c for c in keep or [id_col] if c not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(keep))]
    source = names[keep.index(text_col)] if text_col in keep else "source"
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), *([] if text_col in keep else [F.col(text_col).alias(source)]))
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        for part in text_slices(batches, text=source, size=SLICE):
            texts = [t or "" for t in part.column(source).to_pylist()]
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if m:
                nats, n = m.entropies(texts)
                best, cls = nats.argmin(1), length_class(n)
                share = np.exp(-(nats - nats.min(1, keepdims=True)) * np.minimum(n, 32)[:, None])
                share = share.max(1) / share.sum(1)
                for i, text in enumerate(texts):
                    if any(map(str.isalpha, text)):
                        langs[i] = lang = m.langs[best[i]]
                        fits = 1.0
                        if m.expected and lang in m.expected:
                            median, most = m.expected[lang]
                            excess = (nats[i, best[i]] - median) / (most[cls[i]] - median)
                            fits = 1 / (1 + np.exp(np.clip(8 * (excess - 1), -40, 40)))
                        scores[i] = float(share[i] * fits)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    out = rows.mapInArrow(run, f"{schema}, lang_pred string, score double")  # kept columns have names of their own here
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "lang_pred", "score", (F.col("score") < accept).alias("rejected"))


def fit_on_folds(docs: DataFrame, folds: int = 4, held_out: int = 2, calibration: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", prune: bool = True) -> Model | None:
    """A calibrated model from all folds of docs but held_out; the calibration fold only calibrates."""
    fold = fold_of(F.col(id_col), folds)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), fold.alias("fold"))
    model = fit(rows.where(~F.col("fold").isin(held_out, calibration)), prune)
    if model:
        calibrate(model, rows.where(F.col("fold") == calibration))
    return model


def identified(docs: DataFrame, model: Model | None, accept: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told and accepted, with the columns they have, whatever their names."""
    names = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    told = predict(docs.toDF(*names.values()), model, accept, names["doc_id"], names["text"], list(names.values()))
    return told.where(~F.col("rejected")).select(*(F.col(n).alias(c) for c, n in names.items()))


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, calibration: int = 3, prune: bool = True) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row, learnt from the rows not held out.

    Rows with a null id are predicted, but belong to no fold and teach nothing; nor do
    rows with a null language or text. An empty table gives an empty result.
    """
    model = fit_on_folds(docs, folds, held_out, calibration, prune=prune)
    out = predict(docs, model)
    held = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
