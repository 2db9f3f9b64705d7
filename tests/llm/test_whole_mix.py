"""The source-mix stage emits whole texts only and ends near its targets."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
from earshot.llm import mixing


def test_stage_keeps_texts_whole(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randrange(999)}" for _ in range(rnd.randint(1, 200))), "abc"[i % 3]) for i in range(90)]
    rows += [(500, "long " * 3000, "d"), (501, "short text", "d"), (700, None, "a"), (None, "no id here", None)]
    rows += [(600, "one text of rows that repeat", "e")] * 41
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = dict(corpus_pipeline.STAGES)["source_mix"](spark, docs, "")
    assert got.columns == docs.columns
    mixed = [tuple(r) for r in got.collect()]
    assert set(mixed) <= set(rows)
    sizes, largest, taken = Counter(), defaultdict(int), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
        largest[s] = max(largest[s], len((t or "").split()))
    for _, t, s in mixed:
        taken[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.fill_targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2.0)
    for s, target in zip(order, targets, strict=True):
        assert abs(taken[s] - target) <= largest[s] / 2 + 1, s
