"""Packing against the tokenizer, and its laws: every id once, no gaps, no padding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from earshot.llm import packing
from earshot.llm.cutting_stock import column_generation, packing_plan, stream_sequence, unpadded
from earshot.llm.packing import pack_documents, packed_sequences, packing_digest

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows, width=1024):
    """Pieces cover each document's ids once and each sequence without gap; gives ids a sequence holds."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in docs)
    by_sequence, found = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        found.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= width and bool(unpadded(at, width))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(r.length for r in rows) == sum(map(len, want))
    return by_sequence


def test_pieces_of_odd_texts(spark):
    rnd = random.Random(3)
    words = ["the", "of", "naïve", "Straße", "日本", "x" * 40, "...", "\n\n", "12345", "don't", "᠎", " ", "🙂"]
    texts = [None, "", " ", "<|endoftext|>", "a<|endoftext|>b", "z" * 5000, " " * 4500, "é" * 3000]
    texts += [" ".join(rnd.choices(words, k=rnd.randint(1, 1500))) for _ in range(60)]
    docs = [(k if k != 5 else None, t) for k, t in enumerate(texts)] + [(2, " ")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, TEXT string").repartition(5)
    rows = pack_documents(df, VOCABULARY).collect()
    check(docs, rows)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    whole = {}
    for r in sorted((r for r in rows if r.doc_id not in (2,)), key=lambda r: r.start):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    for i, t in docs[:-1]:
        if i != 2:
            want = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
            assert whole[i] == want.tobytes()


def test_digest_and_sequences(spark):
    docs = [(k, "word " * (k * 37 % 900)) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing_digest(df, VOCABULARY).collect()
    by_sequence = check(docs, rows)
    pieces = pack_documents(df, VOCABULARY)
    for p, r in zip(sorted(pieces.collect(), key=lambda p: (p.doc_id, p.start)), sorted(rows, key=lambda r: (r.doc_id, r.start)), strict=True):
        assert r.ids_crc32 == zlib.crc32(bytes(p.ids))
    for r in packed_sequences(pieces).collect():
        assert len(r.ids) == 4 * sum(p.length for p in by_sequence[r.sequence_id])


def test_starts_by_join(spark, monkeypatch):
    docs = [(k, "some words here " * (k % 50)) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(packing, "FEW_STARTS", 2)
    check(docs, pack_documents(df, VOCABULARY).collect())


def test_empty_table(spark):
    assert packing_digest(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_are_full_and_within_the_counts(seed):
    counts = np.bincount(np.random.default_rng(seed).integers(1, 64, 3000), minlength=64)
    patterns = column_generation(counts, 64)
    used = np.zeros(64)
    for pattern, times in patterns:
        assert unpadded(sum(n * a for n, a in pattern.items()), 64)
        for n, a in pattern.items():
            used[n] += a * times
    assert (used <= counts + 1e-6).all()
    assert sum(t for _, t in patterns) > 0.9 * (counts @ np.arange(64)) / 64


def test_plan_of_a_tiny_case_is_the_optimum():
    """3 x (40 + 24), 2 x (32 + 32): five full sequences and nothing in the stream."""
    counts = np.zeros(64, np.int64)
    counts[[40, 24, 32]] = 3, 3, 4
    plan = packing_plan(counts, 64)
    assert plan.sequences == 5 and plan.stream_tokens == 0


def test_stream_ends_in_powers_of_two():
    sizes = {}
    for at in range(1000):
        number, begin, end = stream_sequence(at, 1000, 256)
        assert begin <= at < end
        sizes[number] = end - begin
    assert sizes == {0: 256, 1: 256, 2: 256, 3: 128, 4: 64, 5: 32, 6: 8}
