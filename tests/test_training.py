"""Training in blocks: its schedule, its plan, and its loss beside that of whole-batch steps."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import blocks, embed
from earshot.operators.blocks import dealt_pairs, rounds, train_blocks, trained_cell, trained_round
from earshot.sources.staging import staged


@pytest.mark.parametrize("n", [1, 2, 4, 10])
def test_every_cell_once_and_no_block_twice_in_a_round(n):
    found = rounds(n)
    assert sorted(c for cells in found for c in cells) == [(i, j) for i in range(n) for j in range(i, n)]
    for cells in found:
        used = [b for cell in cells for b in set(cell)]
        assert sorted(used) == list(range(n))


def communities(spark, seed=1, n=40, m=6000, hot=False):
    """Pairs within two groups of users and artists, and drawn pairs as negatives."""
    rnd = random.Random(seed)
    out = []
    for _ in range(m):
        u = rnd.randrange(n)
        a = 0 if hot and rnd.random() < 0.4 else rnd.randrange(n // 2) * 2 + u % 2
        out.append(("user", u, "artist", a, 1))
        out.append(("user", u, "artist", rnd.randrange(n), 0))
    pairs = spark.createDataFrame(out, "a_type string, a_id long, b_type string, b_id long, label int")
    nodes = spark.createDataFrame([(t, i) for t in ("user", "artist") for i in range(n)], "node_type string, node_id long")
    return staged(pairs, "pairs"), nodes


@pytest.mark.parametrize("n_blocks", [1, 4])
def test_loss_is_below_that_of_one_batch(spark, n_blocks):
    pairs, nodes = communities(spark, hot=n_blocks > 1)
    start = embed.start_vectors(nodes, 4)
    whole = embed.train(pairs, nodes, 4, 0.1, 3, 1, cut=lambda d: staged(d, "vec"))
    mini = train_blocks(pairs, start, 0.1, 3, 512, blocks=n_blocks)
    assert mini.count() == nodes.count()
    before, one, many = (embed.sgns_loss(pairs, v).first().loss for v in (start, whole, mini))
    assert many < one < before


def test_same_vectors_again(spark):
    pairs, nodes = communities(spark, m=500)
    start = embed.start_vectors(nodes, 4)
    runs = [train_blocks(pairs.repartition(k), start, 0.1, 2, 64, blocks=2).collect() for k in (1, 5)]
    a, b = ({(r.node_type, r.node_id): r.vec for r in run} for run in runs)
    assert a == b


def test_a_round_shuffles_vectors_only(spark):
    pairs, nodes = communities(spark, m=500)
    dealt = dealt_pairs(pairs, 4)
    assert dealt.agg(F.sum("n")).first()[0] == pairs.count()
    now = staged(embed.start_vectors(nodes, 4).selectExpr("*", "vec as sq", "cast(pmod(xxhash64(node_type, node_id), 4) as int) as block"), "v")
    cells = rounds(4)[1]
    plan = trained_round(now, dealt, cells, 1, 4, 0.1, 64, 1)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line for line in plan.splitlines()) == 1 and "Bucketed: true" in plan


def test_blocks_follow_the_counts():
    assert blocks.blocks_for(10, 10) == 1
    n = blocks.blocks_for(10**9, 10**6)
    assert n % 2 == 0 and 10**9 / (n * n / 2) <= blocks.CELL_PAIRS
    with pytest.raises(ValueError):
        train_blocks(None, None, blocks=3)


def test_cell_step_is_adagrad_of_the_mean():
    vec, sq = np.array([[1.0, 0.0], [0.0, 1.0]]), np.zeros((2, 2))
    trained_cell(vec, sq, np.array([0, 0]), np.array([1, 1]), np.array([1.0, 0.0]), np.array([3.0, 1.0]), 0.1, 8, np.arange(2))
    mean = (3 * (0.5 - 1) + 1 * 0.5) / 4
    assert np.allclose(sq, [[0, mean**2], [mean**2, 0]]) and np.allclose(vec, [[1, 0.1], [0.1, 1]])


def test_word2vec_tells_two_communities(spark):
    rnd = random.Random(3)
    walks = []
    for w in range(400):
        side = w % 2
        walks.append((w, [("user" if k % 2 == 0 else "artist", rnd.randrange(6) * 2 + side) for k in range(12)]))
    df = spark.createDataFrame(walks, "walk_id long, nodes array<struct<node_type: string, node_id: long>>")
    found = {(r.node_type, r.node_id): np.array(r.vec) for r in embed.train_word2vec(df, 8, 4, 8, rate=0.1).collect()}
    assert len(found) == 24
    unit = {k: v / np.linalg.norm(v) for k, v in found.items()}
    near = [float(unit[a] @ unit[b]) for a in unit for b in unit if a < b and a[1] % 2 == b[1] % 2]
    far = [float(unit[a] @ unit[b]) for a in unit for b in unit if a < b and a[1] % 2 != b[1] % 2]
    assert np.mean(near) > np.mean(far) + 0.2
    with pytest.raises(ValueError):
        embed.train_word2vec(df, 8, most=10)
