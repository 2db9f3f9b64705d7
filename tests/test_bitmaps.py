"""Bitmaps of ids against plain sets; events are filtered and numbered without a shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from earshot.operators import bitmaps, clean
from earshot.operators.bitmaps import id_bitmaps, keep_marked, number_marked
from earshot.operators.playcount import dense_events, number_events
from earshot.operators.ids import dense_ids

SETS = {
    "dense": list(range(-3000, 5000)),
    "holes": [i for i in range(-4000, 90_000, 7)] + [0, 63, 64, 1023, 1024],
    "far": [-(2**62), -1, 0, 1, 2**53 + 1, 2**62, 2**63 - 1, -(2**63)],
    "none": [],
}


@pytest.mark.parametrize("broadcast", [True, False])
def test_membership_and_rank(spark, monkeypatch, broadcast):
    monkeypatch.setattr(bitmaps, "MOST_BYTES", 1 << 26 if broadcast else -1)
    rnd = random.Random(2)
    frames = {k: spark.createDataFrame([(i,) for i in v + v[:5]] + [(None,)], "id long") for k, v in SETS.items()}
    found = id_bitmaps(frames)
    asked = [rnd.randint(-6000, 95_000) for _ in range(3000)] + SETS["far"] + [None]
    df = spark.createDataFrame([(i, f"t{i}") for i in asked], "x long, t string").repartition(3)
    for name, ids in SETS.items():
        rank = {v: k for k, v in enumerate(sorted(set(ids)))}
        want = sorted((i, f"t{i}") for i in asked if i in rank)
        assert found[name].n_ids == len(rank)
        assert sorted(map(tuple, keep_marked(df, found[name], "x").collect())) == want
        numbered = number_marked(df, found[name], "x", "n").select("n", "t").collect()
        assert sorted(map(tuple, numbered)) == sorted((rank[i], t) for i, t in want)


def test_bitmaps_of_close_ids_are_small(spark):
    found = id_bitmaps({"a": spark.range(100_000).select("id")})["a"]
    assert found.n_bytes < 50_000


def _events(spark, tmp_path):
    spark.range(5000).selectExpr(
        "id % 97 as user_id", "id % 13 as artist_id", "id % 31 as album_id", "id % 53 as track_id", "id as timestamp"
    ).write.parquet(str(tmp_path / "le"))
    return spark.read.parquet(str(tmp_path / "le"))


def shuffles(df):
    """Exchanges of the plan that are no broadcasts."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "BroadcastExchange" not in line for line in text.splitlines())


def test_four_keys_without_a_shuffle_of_events(spark, tmp_path):
    events = _events(spark, tmp_path)
    good = {k: spark.range(n).where("id % 3 <> 1") for k, n in (("user_id", 97), ("artist_id", 13), ("album_id", 31), ("track_id", 53))}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = clean.filter_events(events, good)
        assert shuffles(kept) == 0
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = events.where(" and ".join(f"{k} % 3 <> 1" for k in good))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))


def test_numbered_events_are_remapped_events(spark, tmp_path):
    events = _events(spark, tmp_path)
    users = events.select("user_id").where("user_id % 4 <> 2").distinct()
    tracks = events.select("track_id").where("track_id % 5 <> 3").distinct()
    marked = id_bitmaps({"user": users, "track": tracks})
    got = number_events(events, marked["user"], marked["track"], "track")
    assert shuffles(got) == 0
    want = dense_events(events, dense_ids(users, "user_id"), dense_ids(tracks, "track_id"), "track")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert got.agg(F.max("user")).first()[0] == users.count() - 1


def test_only_what_is_read_is_built(spark, monkeypatch):
    """Queries on nodes write no edge ranges, and one relation's query those of that relation only."""
    from earshot.operators import ids
    from earshot.plans import queries
    from earshot.sources import staging

    written = []
    monkeypatch.setattr(ids, "BUCKET_ROWS", 500)
    monkeypatch.setattr(ids, "staged", lambda d, n: written.append((n, tuple(d.columns))) or staging.staged(d, n))
    edges = lambda: [c for n, c in written if n == "ranges" and "raw_id" not in c]
    sf = "/root/testdata/sf0.001"
    queries.QUERIES["node_counts"](spark, sf)
    queries.QUERIES["negative_walks"](spark, sf)
    queries.QUERIES["node_features_identity"](spark, sf)
    queries.QUERIES["sgns_step"](spark, sf)  # reads pairs without ids
    assert not edges()
    queries.QUERIES["listen_edges_artist"](spark, sf)
    assert len(edges()) == 1


def test_events_are_staged_once(spark):
    from earshot.plans import queries
    from earshot.sources import staging

    cleaned = queries._clean(spark, "/root/testdata/sf0.001", "le", "user", "artist")
    assert cleaned["le"] in staging._STAGED
    assert queries.stage_tables(cleaned, ("le", "user", "artist"))["le"] is cleaned["le"]
