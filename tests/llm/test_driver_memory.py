"""Tables that grow with the corpus do not go through the driver, whatever Spark takes them for."""

from __future__ import annotations

import numpy as np
import pytest

from earshot.llm.common import stored
from earshot.llm.graph import components
from earshot.llm.near_copies import meeting
from earshot.llm.simhash import near_links


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 300])
def test_replicas_of_fingerprints_are_not_broadcast(spark, n):
    prints = [int(x) for x in np.random.default_rng(n).integers(-(2**63), 2**63, n)]
    prints += [p ^ 5 for p in prints]
    links = near_links(stored(spark.createDataFrame([(p,) for p in prints], "fp long"), "prints"))
    assert "Broadcast" not in _plan(links)
    assert {tuple(r) for r in links.collect()} >= {(min(p, p ^ 5), max(p, p ^ 5)) for p in prints}


def test_members_of_lists_are_not_broadcast(spark):
    told = spark.createDataFrame([(1, 5, 10, 0), (1, 6, 10, 1)], "token long, node long, n int, place int")
    one = told.toDF("token", "other", "m", "o_place")
    pairs = meeting(told, one)
    assert "Broadcast" not in _plan(pairs)
    assert pairs.count() == 4


def test_labels_of_components_stay_right(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
