"""Cases that were once lost or cost too much."""

from __future__ import annotations

import random

from earshot.llm import near_copies
from earshot.llm.decontaminate import RATE, SHORTEST, Matcher, masks, plain, whole_distance
from earshot.llm.near_copies import meeting, prefixes, shingles


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_short_items_get_the_edits_of_the_rate():
    matcher = Matcher([(1, "what is the capital")], RATE, SHORTEST)
    assert matcher.find("q what is the capitol y") == [(1, 1)]
    assert matcher.find("What  is the capital") == [(1, 0)]
    assert not matcher.find("what is the capitalism") and not matcher.find("what is a capital")
    rnd = random.Random(1)
    for _ in range(1500):
        words = ["ab", "abc", "b", "cab", "bca", "aa"]
        item = " ".join(rnd.choices(words, k=8))[: rnd.randint(3, 19)].strip()
        text = f" {' '.join(rnd.choices(words, k=20))} "
        edits = int(RATE * len(plain(item)))
        gaps = [i for i, c in enumerate(text) if c == " "]
        near = [distance(item, text[a + 1 : b]) for k, a in enumerate(gaps) for b in gaps[k + 1 :] if abs(b - a - 1 - len(item)) <= edits]
        best = min(near, default=99)
        assert Matcher([(1, item)], RATE, SHORTEST).find(text) == ([(1, best)] if best <= edits else [])


def test_whole_distance():
    rnd = random.Random(2)
    for _ in range(1000):
        a, b = ("".join(rnd.choices("ab ", k=rnd.randint(k, 12))) for k in (1, 0))
        assert whole_distance(masks(a), len(a), b) == distance(a, b)


def test_survivor_of_equal_texts_does_not_depend_on_partitions(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text, f"s{k}") for k in range(6)] * 2 + [(None, text, "s9"), (8, "another text " * 9, None), (8, "another text " * 9, "z")]
    found = set()
    for k in (1, 2, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, Source string").repartition(k)
        found.add(tuple(sorted(map(tuple, near_copies.without_near_copies(df).select("doc_id", "Source").collect()), key=repr)))
    assert len(found) == 1 and len(next(iter(found))) == 2


def templated(spark, n):
    """List entries of pages that share 45 words around 5 of their own: similarity 0.67."""
    import numpy as np

    sets = [shingles(" ".join([*(f"t{k}" for k in range(22)), *(f"own{i}x{k}" for k in range(5)), *(f"t{k}" for k in range(22, 45))])) for i in range(n)]
    counters = np.zeros(near_copies.COUNTERS, np.uint32)
    for s in sets:
        counters[s & (near_copies.COUNTERS - 1)] += 1
    owner, token, place = prefixes(sets, counters)
    rows = [(int(t), int(o), len(sets[o]), int(p)) for o, t, p in zip(owner, token, place, strict=True)]
    return spark.createDataFrame(rows, "token long, node long, n int, place int")


def test_pages_of_one_template_do_not_all_meet(spark):
    for n in (200, 400):
        told = templated(spark, n)
        assert told.groupBy("token").count().where(f"count >= {n}").count() >= 1  # one list holds all
        one = told.toDF("token", "other", "m", "o_place")
        assert meeting(told, one).where("node <> other").count() == 0


def test_shapes_that_fit_meet(spark):
    told = spark.createDataFrame([(1, 1, 100, 0), (1, 2, 90, 3), (1, 3, 60, 0), (1, 4, 100, 15), (2, 5, 100, 0)], "token long, node long, n int, place int")
    one = told.toDF("token", "other", "m", "o_place")
    met = {(r.node, r.other) for r in meeting(told, one).collect() if r.node < r.other}
    want = set()
    rows = told.collect()
    for a in rows:
        for b in rows:
            if a.token == b.token and a.node < b.node and 9 * min(a.n - a.place, b.n - b.place) >= 4 * (a.n + b.n):
                want.add((a.node, b.node))
    assert met == want and (1, 2) in want
