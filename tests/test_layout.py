"""Bucketed tables, the event store and walks over it: what moves and what does not."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from earshot.operators import csr, playcount, walks
from earshot.operators.ids import dense_ids, remap
from earshot.sources.buckets import hot_keys, read_bucketed, write_bucketed
from earshot.sources.event_store import read_events, write_events


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [x for x in plan(df).splitlines() if "Exchange" in x and "BroadcastExchange" not in x]


def make(spark, hot=False):
    users = "case when id % 3 = 0 then 5 else id % 41 end" if hot else "id % 41"
    return spark.range(6000).selectExpr(f"{users} as user", "id % 13 as artist", "id % 31 as album", "cast(null as long) as track", "id as ts")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_groups_by_user_without_a_shuffle(spark, tmp_path):
    events = make(spark)
    store = write_events(events, str(tmp_path / "s"), "user", "ts", 4)
    assert store.hot is None
    for work in (
        lambda e: playcount.playcount(playcount.of_item(e, "artist")),
        lambda e: playcount.relative_playcount(playcount.of_item(e, "album")),
        lambda e: playcount.user_plays(playcount.of_item(e, "artist")),
    ):
        found = store.by_user(work)
        assert not exchanges(found)
        assert rows(found) == rows(work(events))
    assert rows(store.by_user(lambda e: playcount.playcount(playcount.of_item(e, "track")))) == []


def test_join_by_user_without_a_shuffle(spark, tmp_path):
    events = make(spark)
    store = write_events(events, str(tmp_path / "s"), "user", "ts", 4)
    ids = dense_ids(events.where("user % 5 <> 2"), "user")
    table = write_bucketed(ids, str(tmp_path / "ids"), "raw_id", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = remap(store.cold, table, "user")
        assert not exchanges(found) and "SortMergeJoin" in plan(found)
        assert rows(found) == rows(remap(events, ids, "user").select(*found.columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_users_lie_beside_the_buckets(spark, tmp_path):
    events = make(spark, hot=True)
    write_events(events, str(tmp_path / "s"), "user", "ts", 4)
    store = read_events(spark, str(tmp_path / "s"))
    assert hot_keys(events, "user", 0.25) == [5]
    assert store.hot.select("user").distinct().collect()[0][0] == 5 and store.cold.where("user = 5").count() == 0
    assert rows(store.events()) == rows(events)
    shares = store.by_user(lambda e: playcount.relative_playcount(playcount.of_item(e, "artist")))
    assert rows(shares) == rows(playcount.relative_playcount(playcount.of_item(events, "artist")))


def test_bucketed_table_is_found_again(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 50 as k", "cast(id as string) as `a b`", "id % 3 as p")
    write_bucketed(df, str(tmp_path / "t"), "k", ["k", "a b"], 4, partition="p")
    found = read_bucketed(spark.newSession(), str(tmp_path / "t"))
    assert rows(found.select("k", "a b", "p")) == rows(df)
    assert write_bucketed(df.limit(0), str(tmp_path / "e"), "k", buckets=2).count() == 0


def bipartite(spark, seed, n=60, m=900):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(n), 0 if k % 3 == 0 else rnd.randrange(n)) for k in range(m)]
    there = spark.createDataFrame(pairs, "src long, dst long")
    return pairs, {"listened_to_artist": there, "artist_listened_by": there.selectExpr("dst as src", "src as dst")}


def brute_walks(pairs, starts, length, per_node, seed=7):
    import hashlib

    out, near = [], ({}, {})
    for a, b in sorted(pairs):
        near[0].setdefault(a, []).append(b)
    for a, b in sorted(pairs, key=lambda p: (p[1], p[0])):
        near[1].setdefault(b, []).append(a)
    for node in starts:
        for copy in range(per_node):
            walk, at = node * per_node + copy, node
            out.append((walk, 0, at))
            for step in range(1, length + 1):
                able = near[(step - 1) % 2].get(at)
                if not able:
                    break
                h = int(hashlib.md5(f"{seed}:{walk}:{step}".encode()).hexdigest()[:8], 16)
                at = able[h % len(able)]
                out.append((walk, step, at))
    return sorted(out)


PATH = ["listened_to_artist", "artist_listened_by"]


def test_walks_are_those_of_sorted_lists(spark, monkeypatch):
    monkeypatch.setattr(csr, "CHUNK", 16)
    monkeypatch.setattr(walks, "CHUNK", 16)
    pairs, edges = bipartite(spark, 4)
    starts = spark.range(70).withColumnRenamed("id", "node_id")
    for hot in (csr.HOT, 40):  # also with chunks that are broadcast to their walkers
        monkeypatch.setattr(csr, "HOT", hot)
        found = walks.walks(starts, edges, PATH, 5, 2)
        assert sorted((r.walk_id, r.step, r.node_id) for r in found.collect()) == brute_walks(pairs, range(70), 5, 2)


def test_a_step_moves_walkers_only(spark):
    _, edges = bipartite(spark, 5)
    near = csr.adjacency(edges, PATH)
    asked = spark.range(1000).selectExpr("id as walk_id", "id % 2 as chunk", "cast(id % 9 as int) as at")
    asked.write.mode("overwrite").format("noop").save()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = near.taken(asked, PATH[0])
        text = plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(exchanges(found)) == 1 and "Bucketed: true" in text
    after = text[text.index("Bucketed: true") - 400 :]
    assert "Exchange" not in after[: after.index("Bucketed: true")].split("SortMergeJoin")[-1].split("ends")[-1]


def test_contexts_need_no_join(spark):
    _, edges = bipartite(spark, 6)
    steps = walks.walks(spark.range(20).withColumnRenamed("id", "node_id"), edges, PATH, 6, 1)
    found = walks.contexts(walks.walk_arrays(steps), 3, 6)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text.split("Aggregate")[0]
    by = {}
    for r in steps.collect():
        by.setdefault(r.walk_id, {})[r.step] = (r.node_type, r.node_id)
    want = [(w, s, k, *n[s], *n[s + k]) for w, n in by.items() for s in range(5) for k in (1, 2) if s in n and s + k in n]
    assert rows(found) == sorted(want, key=repr)
    drawn = walks.negative_arrays(spark.range(3).withColumnRenamed("id", "node_id"), {"user": 9, "artist": 5}, PATH, 6, 1, 2)
    assert "Join" not in plan(walks.contexts(drawn, 3, 6)) and walks.contexts(drawn, 3, 6).count() == 3 * 2 * 10
    assert {(r.negative, len(r.nodes)) for r in drawn.collect()} == {(0, 7), (1, 7)}


def test_walk_that_ends_has_only_its_own_pairs(spark):
    nodes = [("user", 1), ("artist", 2)]
    df = spark.createDataFrame([(7, nodes)], "walk_id long, nodes array<struct<node_type: string, node_id: long>>")
    assert rows(walks.contexts(df, 3, 6)) == [(7, 0, 1, "user", 1, "artist", 2)]
    assert walks.contexts(df, 9, 6).count() == 0


def test_hot_chunks_need_many_walkers(spark, monkeypatch):
    asked = spark.range(3000).select((F.col("id") % 1000 * (F.col("id") % 2)).alias("chunk"))
    assert csr.hot_chunks(asked, 3000) == []
    monkeypatch.setattr(csr, "HOT", 100)
    assert csr.hot_chunks(asked, 3000) == [0]
