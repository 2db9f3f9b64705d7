"""Properties of ids, samples, graph, walks and embeddings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from earshot.operators import embed, sampling, walks
from earshot.operators.edges import RELATIONS, Graph, listen_edges, relations_of, reverse, weighted_edges
from earshot.operators.ids import dense_ids, positions
from earshot.sources import staging, store


def test_dense_ids_do_not_depend_on_buckets(spark):
    rnd = random.Random(1)
    ids = [rnd.randint(-50, 10_000) for _ in range(700)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "x long")
    want = {v: k for k, v in enumerate(sorted(set(ids)))}
    for buckets in (1, 3, 16):
        assert {r.raw_id: r.node_id for r in dense_ids(df, "x", buckets).collect()} == want


def test_no_single_partition_for_many_buckets(spark):
    df = spark.range(1000).withColumnRenamed("id", "x")
    plan = dense_ids(df, "x", 8)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan


def greedy(people, n, seed):
    import hashlib

    left = sampling.quotas(n)
    out = set()
    for p in sorted(people, key=lambda p: hashlib.md5(f"{seed}:{p['user_id']}".encode()).hexdigest()):
        if all(left[m].get(p[m], 0) > 0 for m in sampling.MARGINS):
            for m in sampling.MARGINS:
                left[m][p[m]] -= 1
            out.add(p["user_id"])
    return out


def test_first_of_each_group(spark):
    """The first few of each group by key, a group of most rows among them, and their places."""
    import hashlib

    people = [(i, "hub" if i % 3 else f"g{i % 7}", 0 if i % 21 == 0 else 5) for i in range(3000)]
    people = [(i, g, {"g0": 0, "hub": 1200}.get(g, 9)) for i, g, _ in people]
    df = sampling.seeded_order(spark.createDataFrame(people, "user_id long, g string, most long"), "user_id", 3)
    want = set()
    for group in {g for _, g, _ in people}:
        mine = sorted((i for i, g, _ in people if g == group), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
        most = {"g0": 0, "hub": 1200}.get(group, 9)
        want |= {(i, group, k) for k, i in enumerate(mine[:most])}
    found = sampling.first_within(df, "g", "most", "place")
    assert {(r.user_id, r.g, r.place) for r in found.collect()} == want
    assert "rangepartitioning" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [7, 60])
def test_quota_sample_is_the_greedy_pass(spark, n):
    rnd = random.Random(n)
    people = [
        {"user_id": i, "country": rnd.choice(list(sampling.COUNTRIES)), "gender": rnd.choice("mfn"), "age_key": rnd.choice(["NA", "good"])}
        for i in range(400)
    ]
    df = spark.createDataFrame(people, "user_id long, country string, gender string, age_key string")
    assert {r.user_id for r in sampling.quota_sample(df, n, 5).collect()} == greedy(people, n, 5)


def test_quotas_sum_up():
    for n in (0, 1, 13, 50, 999):
        for margin in sampling.quotas(n).values():
            assert sum(margin.values()) == n and min(margin.values()) >= 0


def events(spark):
    return spark.createDataFrame([(0, 0, 5), (0, 0, 5), (0, 1, 3), (1, 1, 4)], "user long, item long, ts long")


def test_repeated_event_is_two_edges_and_plays(spark):
    edges = listen_edges(events(spark)).collect()
    assert sorted(e.edge_id for e in edges) == [0, 1, 2, 3] and sum((e.src, e.dst) == (0, 0) for e in edges) == 2
    weights = {(e.src, e.dst): e.weight for e in weighted_edges(events(spark)).collect()}
    assert weights == {(0, 0): 2.0, (0, 1): 1.0, (1, 1): 1.0}
    shares = weighted_edges(events(spark), normalize=True).groupBy("src").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in shares)


def test_reverse_swaps(spark):
    forward = {(e.edge_id, e.src, e.dst) for e in listen_edges(events(spark)).collect()}
    back = {(e.edge_id, e.dst, e.src) for e in reverse(listen_edges(events(spark))).collect()}
    assert forward == back


def test_relations_of_combinations():
    assert set(relations_of(True, True, True)) == set(RELATIONS)
    assert set(relations_of(False, False, True)) == {"listened_to_track", "track_listened_by"}
    with pytest.raises(ValueError):
        relations_of(False, False, False)


def test_metapaths_are_closed_chains():
    for kinds in (["artist"], ["album"], ["track"], ["artist", "album"], ["artist", "track"], ["album", "track"], ["artist", "album", "track"]):
        walks.check_chain(walks.metapath(kinds))
    assert walks.metapath(["album", "track"])[0] == "listened_to_album"
    with pytest.raises(ValueError):
        walks.metapath(["genre"])


def test_walk_steps_are_edges(spark):
    forward = listen_edges(events(spark))
    edges = {"listened_to_artist": forward, "artist_listened_by": reverse(forward)}
    path = ["listened_to_artist", "artist_listened_by"]
    starts = spark.createDataFrame([(0,), (1,), (2,)], "node_id long")
    found = walks.walks(starts, edges, path, 4, 2).collect()
    by = {}
    for r in found:
        by.setdefault(r.walk_id, {})[r.step] = r.node_id
    pairs = {(e.src, e.dst) for e in forward.collect()}
    for steps in by.values():
        for k in range(len(steps) - 1):
            a, b = steps[k], steps[k + 1]
            assert ((a, b) if k % 2 == 0 else (b, a)) in pairs
    assert len(by[4]) == 1 and len(by[0]) == 5
    apart = walks.contexts(walks.walk_arrays(walks.walks(starts, edges, path, 4, 2)), 3, 4)
    assert apart.where("walk_id = 0").count() == 6


def test_training_lowers_the_loss(spark):
    pairs = spark.createDataFrame(
        [("u", i % 4, "a", i % 4, 1) for i in range(16)] + [("u", i % 4, "a", (i + 1) % 4, 0) for i in range(16)],
        "a_type string, a_id long, b_type string, b_id long, label int",
    )
    nodes = spark.createDataFrame([(t, i) for t in "ua" for i in range(4)], "node_type string, node_id long")
    before = embed.sgns_loss(pairs, embed.start_vectors(nodes, 4)).first().loss
    after = embed.sgns_loss(pairs, embed.train(pairs, nodes, 4, 0.5, 3, 1, cut=lambda d: staging.staged(d, "vec"))).first().loss
    assert after < before


def test_default_training_lowers_the_loss(spark):
    pairs = spark.createDataFrame(
        [("u", i % 9, "a", i % 9, 1) for i in range(45)] + [("u", i % 9, "a", (i * 4 + 1) % 9, 0) for i in range(45)],
        "a_type string, a_id long, b_type string, b_id long, label int",
    )
    nodes = spark.createDataFrame([(t, i) for t in "ua" for i in range(9)], "node_type string, node_id long")
    before = embed.sgns_loss(pairs, embed.start_vectors(nodes, 8)).first().loss
    after = embed.sgns_loss(pairs, embed.train(pairs, nodes, 8, cut=lambda d: staging.staged(d, "vec"))).first().loss
    assert after < 0.95 * before


def test_positions_of_a_hot_value(spark):
    df = spark.range(1000).selectExpr("7L as src", "id % 3 as dst")
    placed = positions(df, ["src", "dst"], "p", 8)
    rows = placed.collect()
    assert sorted(r.p for r in rows) == list(range(1000)) and [r.dst for r in sorted(rows, key=lambda r: r.p)] == sorted(r.dst for r in rows)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_ranges_of_a_hot_value_are_even(spark, monkeypatch):
    kept = []
    monkeypatch.setattr("earshot.operators.ids.staged", lambda d, n: kept.append(staging.staged(d, n)) or kept[-1])
    positions(spark.range(4000).selectExpr("1L as src"), ["src"], "p", 8)
    assert max(r["count"] for r in kept[0].groupBy("_range").count().collect()) < 1500


def test_graph_round_trip(spark, tmp_path):
    ids = {k: spark.createDataFrame([(10 + i, i) for i in range(2)], "raw_id long, node_id long") for k in ("user", "artist")}
    forward = listen_edges(events(spark))
    graph = Graph(ids, {"listened_to_artist": forward, "artist_listened_by": reverse(forward)})
    store.write_graph(graph, str(tmp_path / "g"))
    again = store.load_graph(spark, str(tmp_path / "g"))
    assert sorted(again.nodes) == ["artist", "user"] and sorted(again.edges) == ["artist_listened_by", "listened_to_artist"]
    assert {(r.part, r.name): r.n for r in store.graph_counts(spark, str(tmp_path / "g")).collect()} == {
        ("node", "user"): 2,
        ("node", "artist"): 2,
        ("edge", "listened_to_artist"): 4,
    }
    for r, df in graph.edges.items():
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.edges[r].select(*df.columns).collect()))
    assert all(r.bad_src == r.bad_dst == 0 for r in again.validate().collect())


def test_positions_with_ties(spark):
    df = spark.createDataFrame([(1, 1)] * 5 + [(2, 1)] * 3, "a long, b long")
    assert sorted(r.p for r in positions(df, ["a", "b"], "p", 4).collect()) == list(range(8))


def test_edges_and_vectors_round_trip(spark, tmp_path):
    forward = listen_edges(events(spark))
    store.write_edges({"listened_to_artist": forward, "artist_listened_by": reverse(forward)}, str(tmp_path / "g"))
    one = store.read_edges(spark, str(tmp_path / "g"), ["listened_to_artist"])
    assert one.count() == 4 and store.read_edges(spark, str(tmp_path / "g")).count() == 8
    vectors = spark.createDataFrame([("user", 1, [1.0]), ("artist", 1, [2.0])], "node_type string, node_id long, vec array<double>")
    store.write_vectors(vectors, str(tmp_path / "v"))
    assert store.read_vectors(spark, str(tmp_path / "v"), "user").count() == 1
