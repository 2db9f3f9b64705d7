"""Queries against their DuckDB SQL on the smallest driver tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from earshot.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("supplier", "part", "lineitem", "orders", "customer", "events", "documents")
SOME = (
    "scan_events",
    "invalid_rows",
    "unnamed_ids",
    "user_profile",
    "filter_events",
    "artist_genre_default",
    "dangling_ids",
    "closure_check",
    "popular_artists",
    "quota_apportion",
    "stratified_sample",
    "relative_playcount_album",
    "weighted_edges_artist",
    "graph_validate",
    "walk_contexts",
    "negative_walks",
    "sgns_step",
    "encode_categorical",
    "encode_text",
    "clean_events_popular",
    "quota_sample_users",
    "subset_events",
    "build_graph",
    "edge_counts",
    "order_seconds",
    "stored_playcounts",
    "stored_table",
    "raw_rejects",
    "stored_vectors",
    "stored_graph_counts",
    "metapath_table",
)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, found.fetchall())


def test_every_query_but_a_few_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"node_embeddings"}
