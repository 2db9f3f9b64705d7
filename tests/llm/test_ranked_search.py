"""Ranked search against the scores of all documents."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from earshot.llm import ranked_search
from earshot.llm.ranked_search import CLASSES, Postings, Shard, best_of_shard, masses, numbers, rank_documents, terms_of, varints, weight


def brute(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(size for *_, size in counted)
    holding = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for doc, c, size in counted:
            m = 10 + 90 * size * n // total
            s = sum(weight(n, holding[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                found.append((-s, doc is None, doc, s))
        out += [(item, rank, doc, s) for rank, (_, _, doc, s) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i * 7 % n + 2**53, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 60)))) for i in range(n)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 8)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("window", [(256, 8192), (8, 16)])
def test_same_as_all_scores(spark, monkeypatch, window):
    docs, items = corpus(1, 500)
    docs += [(None, "w1 w2 w250"), (3, None), (4, ""), (5, "W1, w2! É é"), (5, "W1, w2! É é"), (6, "w299 " * 3000)]
    items += [(1, "W1 w250 w250 É"), (None, "w2"), (7, None), (8, "..."), (9, "unseen")] + items[:2]
    monkeypatch.setattr(ranked_search, "WINDOWS", window)
    monkeypatch.setattr(ranked_search, "SHARD_DOCUMENTS", 90)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, TEXT string").repartition(3)
    rows = rank_documents(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    docs, items = corpus(2, 200)
    monkeypatch.setattr(ranked_search, "QUERY_BLOCK", 6)
    found = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(docs, items).count() == 0
    assert rank_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 129, 16383, 16384, 2**21, 2**28 + 5, 2**35 + 1])
    data, ends = varints(values)
    assert (numbers(data.tobytes()) == values).all() and ends[-1] == len(data)


def test_bounds_hold_and_blocks_stay_compressed():
    """No posting scores above its block's bound, and a rare word spares most blocks of a common one."""
    rnd = random.Random(5)
    shard = Shard()
    for i in range(6000):
        words = ["common"] * (1 if i >= 256 else 5) + ["filler"] * rnd.randint(0, 30) + (["rare"] if i in (3, 40, 77, 200, 1000, 5000) else [])
        shard.add(i, False, " ".join(words))
    rows = list(shard.rows("0-0"))
    lengths = np.frombuffer(rows[0][5], np.int64)
    total = int(lengths.sum())
    mass = masses(lengths, 6000, total)
    named = {r[1]: type("Row", (), dict(zip(("ends", "sizes", "tops", "data"), r[4:], strict=True))) for r in rows[1:]}
    mass_of = lambda n: masses(n.ravel(), 6000, total).reshape(n.shape)
    lists = {t: Postings(r, w, mass_of) for (t, r), w in zip(named.items(), (1, 1, 5000), strict=True)}
    lists["common"].weight = 1
    for p in lists.values():
        for b in range(len(p.last)):
            at, counts = p.decoded(b, b + 1)
            assert (p.weight * ranked_search.damped(counts, mass[at]) <= p.bounds[b]).all()
    tell = {}
    places, scores = best_of_shard([lists["common"], lists["rare"]], mass, 4, tell)
    assert len(places) == 4 and (np.diff(scores) <= 0).all()
    assert tell["blocks"] < len(lists["common"].last) / 2 and len(CLASSES) == 4
