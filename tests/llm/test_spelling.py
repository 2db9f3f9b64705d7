"""Spelling variants against the neighbourhoods of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import spelling
from earshot.llm.spelling import decomposed, most_touched, signature, spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute_words(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(docs):
    counts = brute_words(docs)
    shelves = {}
    for w in counts:
        for key in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            shelves.setdefault(key, set()).add(w)
    near = {w: set() for w in counts}
    for shelf in shelves.values():
        for a in shelf:
            near[a] |= {b for b in shelf if one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts), near


def found(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def make(seed, n_words=400, n_docs=300):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices("abcé", k=rnd.randint(4, 9))) for _ in range(n_words)]
    docs = [(i, " ".join(rnd.choices(stems, [1 / (k + 1) for k in range(n_words)], k=120))) for i in range(n_docs)]
    long = "".join(rnd.choices("xyz", k=3000))
    for k in (62, 63, 64, 65):
        docs.append((k, f"{long[:k]} {long[:k]} {long[:k]} {'a' * k} {'a' * k} {'a' * k}"))
    docs += [(None, f"{long} {long[:-1]} Çaça-Über×÷ÿ NAÏVETÉ"), (7, None), (8, "")] + [(9, f"{long} {long[:-1]} {long[1:]}")] * 3
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_neighbourhoods(spark, monkeypatch, seed):
    monkeypatch.setattr(spelling, "GRAMS", 500)  # a small vocabulary has frequent grams too
    docs = make(seed)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, TEXT string").repartition(4)
    want, near = brute(docs)
    assert sum(map(len, near.values())) > 200
    assert found(spelling_variants(df)) == want


def test_empty_and_wordless_tables(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).count() == 0


def test_roots_follow_forms(spark):
    text = " ".join(["aaaaab"] * 3 + ["aaaabb"] * 6 + ["aaabbb"] * 12 + ["aabbbb"] * 24 + ["abbbbb"] * 48)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want, _ = brute([(1, text)])
    assert found(spelling_variants(df)) == want
    assert {w[2] for w in want} == {"abbbbb"}


WORDS = st.text("abc", min_size=5, max_size=12)


@settings(max_examples=400, deadline=None)
@given(WORDS, st.integers(0, 12), st.sampled_from("abcd"), st.sampled_from("rid"), st.integers(0, 40))
def test_signatures_of_near_words_meet(word, at, char, kind, above):
    """Whatever the dictionary: a word and its edit share an indexed gram, one place apart at most."""
    at = min(at, len(word) - (kind != "i"))
    other = word[:at] + ("" if kind == "d" else char) + word[at + (kind != "i") :]
    if other == word or len(other) < 5:
        return
    rnd = random.Random(above)
    counts = {a + b: rnd.randint(0, 60) for a in "^abcd" for b in "abcd$"}
    counts |= {g + c: rnd.randint(0, 30) for g in list(counts) for c in "abcd$"}
    counts |= {g + c: rnd.randint(0, 30) for g in list(counts) if len(g) == 3 for c in "abcd$"}
    mine, theirs = signature(word, counts, above), signature(other, counts, above)
    far = lambda i, j: j - i not in ((0,) if len(word) == len(other) else (0, 1) if len(other) > len(word) else (0, -1))
    assert any(g == h and not far(i, j) for g, i in mine for h, j in theirs)
    grams = decomposed(word, counts, above)
    assert len(grams) > most_touched(grams)
