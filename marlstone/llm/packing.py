"""Packing of tokenised documents into sequences by minimum bin slack.

The lengths of all pieces form a histogram of at most `capacity` rows, whatever the
size of the corpus. Over it, per bin, a bitset subset-sum finds the fullest feasible
combination beside the largest piece left; the combination is removed as often as the
histogram allows. So the plan is bounded by the capacity, and the pieces are dealt to
it in parallel by their rank among equal lengths.
"""

from __future__ import annotations

import codecs
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import kept_by_worker, stash, text_slices, utf8

#: Words and parts that a worker's tables hold, at most; each takes some 250 bytes.
CACHED_WORDS = 750_000


class WordEncoder:
    """Token ids of texts, as little-endian bytes, by way of tables of words and their parts met before.

    For tokenizers that drop white space and never join across it, so words encode
    alone. Words of Latin-1 letters are split by the tokenizer's own pattern here, which
    is cheaper than in its pipeline, and only new parts are encoded; other words go
    through the whole pipeline.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.ids("a b\n").tolist() != [*self.ids("a"), *self.ids("b")]:
            raise ValueError(f"{path} doesn't encode words alone")
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        form = json.loads(self.tokenizer.to_str())
        shape = [form["model"].get("end_of_word_suffix"), *(n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])), *(p["type"] for p in (form["pre_tokenizer"] or {}).get("pretokenizers", []))]
        self.inner = None
        if shape == ["</w>", "NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            self.split = regex.compile(form["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "| ").findall
            self.inner = Tokenizer.from_str(json.dumps(form | {"normalizer": None, "added_tokens": []}))
            self.inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(max(form["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in form["model"]["vocab"].items() if t.endswith("</w>")]] = True
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are shown from U+0100 on
            others = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown))) if b != ord(" ")}
            self.shown = "".join(chr(others.get(b, b)) for b in range(256))
            self.letters_alone = self.split("abcxyz") == ["abcxyz"]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def cut(text: bytes) -> list[bytes]:
        """Words, with ASCII letters in lower case but where a special token or a combining mark (U+0300 to U+036F) makes a difference."""
        return (text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()).split()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = [self.cut(t) for t in texts]
        if len(self.words) + len(self.parts) > CACHED_WORDS:
            self.words.clear()
            self.parts.clear()
        self.learn(set(filterfalse(self.words.__contains__, chain.from_iterable(words))))
        return [b"".join(map(self.words.__getitem__, w)) for w in words]

    def learn(self, words: set[bytes]) -> None:
        plain = []
        if self.inner is not None and self.letters_alone:  # a word of ASCII letters is one part
            letters = [w for w in words if w.isalpha()]
            if letters:
                parts = b" ".join(letters).decode().lower().split(" ")
                self.learn_parts(set(parts).difference(self.parts))
                self.words.update(zip(letters, map(self.parts.__getitem__, parts)))
            words = words.difference(letters)
        for w in words:
            if self.inner is None or b"<|" in w or max(w) > 0xC3:  # beyond Latin-1
                self.words[w] = self.ids(w.decode()).tobytes()
            else:
                plain.append(w)
        if not plain:
            return
        found = self.split(b" ".join(plain).decode().lower())
        self.learn_parts(set(found).difference(self.parts, (" ",)))
        self.parts[" "] = b""
        coded = list(map(self.parts.__getitem__, found))
        at = 0
        ends = [i for i, part in enumerate(found) if part == " "]
        for w, end in zip(plain, [*ends, len(found)], strict=True):
            self.words[w] = coded[at] if end - at == 1 else b"".join(coded[at:end])
            at = end + 1

    def learn_parts(self, parts: set[str]) -> None:
        """All at once: the tokenizer sees them between blanks, as the characters their bytes are shown by; a token that ends a word ends a part."""
        if not parts:
            return
        new = list(parts)
        shown = " ".join(new)
        if not shown.isascii() or not shown.isprintable():
            shown = codecs.charmap_decode(shown.encode(), "strict", self.shown)[0]
        ids = np.array(self.inner.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        ends, flat, at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes(), 0
        for part, end in zip(new, ends, strict=True):
            self.parts[part] = flat[at:end]
            at = end


def encoder(tokenizer: str) -> WordEncoder:
    """One per worker process, until another operator's task lets it go. tokenizer: a file's path, or the name of an installed public one."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def load() -> WordEncoder:
        path = tokenizer
        if "/" not in tokenizer:
            import public_tokenizers

            path = str(public_tokenizers.path(tokenizer))
        return WordEncoder(path)

    return kept_by_worker(f"encoder {tokenizer}", load)


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document with their rank among equal lengths of the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        met = np.zeros(capacity + 1, np.int64)
        step = 4 * capacity
        for part in text_slices(batches):
            rows = []
            for doc, found in zip(part.column("doc_id").to_pylist(), encode(utf8(part, "text"))):
                ids = found + end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    n = len(piece) // 4
                    rows.append((doc, k, k * capacity, n, zlib.crc32(piece), task, int(met[n])))
                    met[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


@dataclass
class Plan:
    """Runs of equal pieces: pieces of `length` from rank `first` on go, `uses` to a sequence, to sequences from `sequence` on, at `offset`."""

    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, uses, sequence, offset


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that leaves the least of room, large lengths first."""
    reach, steps, within = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        left = min(counts[n], room // n)
        take = 1
        while left > 0:
            take = min(take, left)
            steps.append((n, take, reach))
            reach |= (reach << (take * n)) & within
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[n] = chosen.get(n, 0) + take
            at -= n * take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Minimum bin slack over a histogram of lengths."""
    counts = {n: c for n, c in counts.items() if c}
    done = dict.fromkeys(counts, 0)
    out = Plan()
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        rest = counts | {first: counts[first] - 1}
        uses = fullest(lengths, rest, capacity - first)
        uses[first] = uses.get(first, 0) + 1
        times = min(counts[n] // k for n, k in uses.items())
        offset = 0
        for n, k in sorted(uses.items(), reverse=True):
            out.runs.append((n, done[n], k, out.sequences, offset))
            offset += n * k
            done[n] += k * times
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.sequences += times
    return out


def place(ranked: DataFrame, packed: Plan) -> DataFrame:
    """Sequence and offset of every piece. The plan has a bounded number of runs, so it goes along with the task.

    ranked has each piece's rank among all of its length, which must be the pieces that
    packed was made for; no pieces give no rows. Null ids pass through.
    """
    runs = np.array(sorted(packed.runs), np.int64).reshape(-1, 5)
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            _, first, uses, sequence, offset = runs[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
            turn = rank - first
            cols = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence + turn // uses), pa.array(offset + turn % uses * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row for every piece.

    A document is its token ids and end_id; only one longer than capacity is cut.
    Null and empty texts are the end_id alone. Rows with null or repeated ids are
    documents of their own. An empty table gives an empty result; other columns are
    not read. The same rows may get other sequences if they are partitioned otherwise.
    """
    cut = stash(pieces(docs, capacity, tokenizer, end_id, id_col, text_col), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    return place(ranked, plan(counts, capacity))
