"""The near-dedup stage against all pairs of exact five-word sets."""

from __future__ import annotations

import random

from earshot.llm import near_copies


def five(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(texts):
    sets, label = {i: five(t) for i, t in texts.items()}, {i: i for i in texts}
    ids = sorted(texts)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    return {i for i in texts if label[i] == i}


def edited(rnd, words, edits):
    out = list(words)
    for at in rnd.sample(range(len(out)), edits):
        out[at] = f"edit{rnd.randrange(10**9)}"
    return " ".join(out)


def test_stage_finds_all_pairs_and_only_those(spark):
    rnd, texts = random.Random(8), {}
    common = [f"c{k}" for k in range(150)]
    for i in range(120):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(50, 250))]
        texts[len(texts)] = " ".join(words)
        # edits that move the similarity to both sides of 0.8
        texts[len(texts)] = edited(rnd, words, max(1, round(len(words) * rnd.choice((0.01, 0.02, 0.022, 0.025, 0.03)))))
        if i % 4 == 0:  # much shared text, and more of the same
            texts[len(texts)] = " ".join(common + words[: rnd.randint(20, 60)])
            texts[len(texts)] = " ".join(words + words[::-1][: len(words) // rnd.randint(4, 9)])
    for _ in range(60):  # a large group, its members further apart than each from the first
        texts[len(texts)] = edited(rnd, common, rnd.randint(1, 4))
    rows = [(i, t) for i, t in texts.items()]
    left = near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(texts)
    assert {r.doc_id for r in left.collect()} == want and 150 < len(want) < len(texts) - 60


def test_parity_bits_never_differ_more_than_the_sets():
    rnd = random.Random(9)
    for _ in range(300):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(0, 300))]
        a, b = (near_copies.shingles(t) for t in (" ".join(words), edited(rnd, words, rnd.randint(0, len(words) // 4))))
        bits = sum(int(x).bit_count() for x in (near_copies.parities(a) ^ near_copies.parities(b)).view("<u8"))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_edited_copies_join_over_the_text_they_come_from(spark):
    rnd = random.Random(10)
    words = [f"w{k}" for k in range(160)]
    texts = {0: " ".join(words)} | {i: edited(rnd, words, 3) for i in range(1, 150)}
    texts |= {i: edited(rnd, words, 12) for i in range(150, 200)}
    left = near_copies.without_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in left.collect()} == brute(texts)
