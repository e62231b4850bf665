import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import ODD, documents, prose
from marlstone.llm import packing

CAP = 64


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def check(rows, found, tokenizer, capacity):
    """Every document's ids come back out of its pieces; sequences are gapless and within capacity."""
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    want = sorted((d is None, d or 0, k, k * capacity, len(x[k * capacity : (k + 1) * capacity]), zlib.crc32(np.array(x[k * capacity : (k + 1) * capacity], "<u4").tobytes())) for (d, _), x in zip(rows, ids) for k in range(-(-len(x) // capacity)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(map(len, ids))


def test_round_trip(spark, tokenizer):
    rows = [(i, prose(i, (7 * i) % 90)) for i in range(300)] + [(900, "It's <|endoftext|> <|ENDOFTEXT|> I'LL ÉTÉ ſ İ x\x1cy a\x85b")]
    found = packing.pack(documents(spark, rows), capacity=CAP).collect()
    n, total = check(rows, found, tokenizer, CAP)
    assert n <= 1.02 * total / CAP + 1


def test_ids_are_those_of_the_whole_text(tokenizer):
    """Words by table and by part give what the tokenizer gives for the text at once."""
    r = np.random.default_rng(1)
    signs = [*"aZé'st ß²\xa0\x85\x1c.$9ÿ\x00\x01\xad\n", "İ", "J\u030c", "e\u0301", "\u0301", "ﬁ", "中", "<|endoftext|>", "<|", "Σ", "'ll", "'D"]
    texts = ["".join(r.choice(signs, r.integers(0, 30))) for _ in range(2000)]
    texts += ["don't we'LL x's's I'd've", "a\u00a0b \u00a0", "12.5€ ①x", "W\u030a T\u0308 É E\u0301"]
    encode = packing.encoder("word_bpe_49k.json")
    for text, ids in zip(texts, encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_tokenizer_that_keeps_blanks_is_refused():
    with pytest.raises(ValueError):
        packing.encoder("byte_bpe_50k.json")


def test_odd_rows(spark, tokenizer):
    docs = documents(spark, ODD)
    check(ODD, packing.pack(docs.withColumnRenamed("source", "rank")).collect(), tokenizer, 4096)
    assert packing.pack(docs.limit(0)).collect() == []


def best_fill(lengths, room):
    reach = {0}
    for n in lengths:
        reach |= {r + n for r in reach if r + n <= room}
    return max(reach)


def test_fullest_is_the_subset_sum_optimum():
    r = np.random.default_rng(0)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(r.choice(40, 6, replace=False) + 3, r.integers(1, 4, 6))}
        room = int(r.integers(0, 90))
        chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert all(0 < k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == best_fill([n for n, c in counts.items() for _ in range(c)], room)


def test_plan_places_every_piece_once():
    counts = {n: 1 + (n * 7) % 5 for n in range(1, CAP + 1)} | {CAP: 100_000, 3: 50_000}
    plan = packing.plan(dict(counts), CAP)
    assert plan.sequences <= 1.01 * sum(n * c for n, c in counts.items()) / CAP + 1
    assert len(plan.runs) < 2000
