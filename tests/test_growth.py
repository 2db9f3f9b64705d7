"""What large graphs read and shuffle more than once is written or looked up instead."""

from __future__ import annotations

import os
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from earshot.functions.schemas import typed
from earshot.operators import blocks, csr, walks
from earshot.operators.edges import Graph, Lazy
from earshot.plans import pipelines, queries
from earshot.sources.staging import FREES, staged, staged_within, staging_dir

SF = "/root/testdata/sf0.001"


def test_nodes_are_found_by_type_and_id():
    nodes = [("album", 3), ("album", 9), ("user", -4), ("user", 3), ("user", 7)]
    rows = blocks._rows_of(pd.DataFrame(nodes, columns=["node_type", "node_id"]))
    asked = [("user", 7), ("album", 9), ("user", 9), ("track", 3), ("album", 99), ("user", -4)]
    types, ids = zip(*asked, strict=True)
    assert rows(pd.Series(types), pd.Series(ids)).tolist() == [4, 1, -1, -1, -1, 2]


def test_runs_end_where_places_chunks_or_relations_do():
    place = np.array([7, 0, 1, 2, 3, 4, 9], np.int64)  # a batch that spans two files
    key = np.array([1, 0, 0, 0, 0, 1, 1], np.int64) << csr.CODE_SHIFT
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(place * 10), pa.array(place)], names=["key", "dst", "place"])
    found = [r for b in csr._runs(3)([batch]) for r in b.to_pylist()]
    got = [(r["code"], r["chunk"], r["first"], r["dsts"]) for r in found]
    assert got == [(0, 0, 0, [0, 10, 20]), (0, 1, 3, [30]), (1, 1, 4, [40]), (1, 2, 7, [70]), (1, 3, 9, [90])]


def test_edges_of_an_adjacency_are_shuffled_for_their_order_only(spark):
    edges = {r: spark.createDataFrame([(k, k % 3) for k in range(9)], "src long, dst long") for r in ("listened_to_artist", "artist_listened_by")}
    near = csr.adjacency(edges, list(edges))
    assert near.chunks.schema["ends"].dataType.simpleString() == "array<bigint>"
    assert near.starts(spark.createDataFrame([(4,), (9,)], "node_id long"), "artist_listened_by").collect() == [(4, 13, 1)]


def test_graphs_are_held_against_their_nodes_without_numbering_an_edge(spark):
    def numbered():
        raise AssertionError("an edge is numbered")

    nodes = {k: spark.createDataFrame([(5, 0), (6, 1)], "raw_id long, node_id long") for k in ("user", "track")}
    pairs = {"listened_to_track": spark.createDataFrame([(0, 1), (2, 0), (-1, 2), (1, 3)], "src long, dst long")}
    found = Graph(nodes, Lazy({"listened_to_track": numbered}), pairs).validate()
    assert [tuple(r) for r in found.collect()] == [("listened_to_track", 2, 2)]


def test_events_of_all_relations_are_numbered_once(spark):
    graph = queries._graph(spark, SF)
    for relation in ("listened_to_artist", "track_listened_by"):
        files = graph.ends()[relation].inputFiles()
        assert files and all("/numbered-" in f for f in files)


def test_played_pairs_are_counted_once(spark):
    pairs, _ = queries._pairs(spark, SF)
    assert all("/played-" in f for f in pairs.inputFiles())


def test_negative_walks_are_dealt_to_tasks_by_their_number(spark):
    starts = spark.range(3).toDF("node_id").coalesce(1)
    counts = {"user": 20_000, "artist": 5, "genre": 2}  # 20,000 starts make 5,400,000 rows
    path = walks.metapath(["artist"])
    for make in (walks.negative_walks, walks.negative_arrays):
        assert make(starts, counts, path, 8, 3, 10).rdd.getNumPartitions() == 6
    rows = walks.negative_walks(starts, counts, path, 8, 3, 10)
    arrays = walks.negative_arrays(starts, counts, path, 8, 3, 10)
    arrays = arrays.select("walk_id", "negative", F.posexplode("nodes").alias("step", "node")).select("walk_id", "negative", "step", "node.*")
    assert rows.count() == 3 * 3 * 10 * 9 and rows.exceptAll(arrays).isEmpty()


def test_nodes_are_counted_without_numbering_them(spark, monkeypatch):
    def numbered(*_):
        raise AssertionError("nodes are numbered")

    monkeypatch.setattr(pipelines, "numbered", numbered)
    counts = {r.node_type: r.n for r in queries.node_counts(spark, SF).collect()}
    assert set(counts) == {"user", "artist", "album", "track", "genre"}
    assert queries.negative_walks(spark, SF).count() == counts["user"] * 3 * 10 * 9


def test_texts_of_events_are_parsed_once(spark):
    plan = queries._table(spark, SF, "le")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == 5  # once a column, none below the joins that make the texts


def test_integers_are_read_as_by_the_pattern(spark):
    texts = ["5", "-5", "+5", "05", "-0", "1.5", "1.", " 5 ", "\t5", "5\n", "\n5", "5\r\n", "", "-", "x5", "1e3", "5 5", "5\x00", None]
    texts += [str(2**63 - 1), str(2**63), str(-(2**63)), "0" * 22 + "7"]
    want = [int(t) if t is not None and re.search("^[+-]?[0-9]+$", t.strip(" ").replace("\r\n", "\n")) and abs(int(t)) <= 2**63 - (t[0] != "-") else None for t in texts]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, user_id string")
    assert {int(r.k): r.user_id for r in typed(df).collect()} == dict(enumerate(want))
    assert typed(df).columns == ["k", "user_id"] and typed(df.select("k")).columns == ["k"]


def test_training_keeps_the_last_vectors_only(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELL_PAIRS", 20_000)
    graph = queries._graph(spark, SF)
    with staged_within(spark):
        folder = staging_dir(spark).removeprefix("file:")
        found = pipelines.embed_graph(graph, length=8, epochs=2)
        assert found.count() == graph.node_table().count()
        kept = [re.sub("-[0-9a-f]{32}$", "", name) for name in os.listdir(folder)]
    # of the walks no adjacency, of the pairs none but those in cells, of the rounds none but the last
    assert kept.count("vectors") == kept.count("cells") == kept.count("walks") == 1
    assert not {"pairs", "ranges", "chunks", "offsets", "asked", "walk"} & set(kept)


def test_what_a_write_has_shuffled_is_deleted(spark):
    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    before, option = shuffled(), spark.conf.get(FREES)
    table = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(100):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(FREES) == option and table.count() == 7


def test_pairs_are_counted_from_the_lengths_of_walks(spark):
    nodes = [("user", k) for k in range(12)]
    df = spark.createDataFrame([(k, nodes[:k]) for k in range(13)], "walk_id long, nodes array<struct<node_type: string, node_id: long>>")
    for window, length in ((3, 6), (7, 8), (7, 11), (9, 6)):
        n = df.agg(F.sum(walks.n_contexts(F.size("nodes").cast("long"), window, length))).first()[0]
        assert n == walks.contexts(df.where(F.size("nodes") <= length + 1), window, length).count() + sum(
            walks.contexts(df.where(F.col("walk_id") == k), window, length).count() for k in range(length + 2, 13)
        )


def test_repeated_pairs_are_packed_once(spark):
    rows = [("user", 1, "artist", b, 1) for b in (5, 3, 5, 9, 5)] + [("user", 1, "artist", 5, 0), ("user", None, "artist", 5, 0)]
    pairs = spark.createDataFrame(rows, "a_type string, a_id long, b_type string, b_id long, label int").repartition(3)
    found = blocks.dealt_pairs(pairs, 1).collect()
    got = sorted((r.label, r.a, r.b, r.times, r.n) for r in found)
    assert got == [(0, [1], [5], [1], 1), (1, [1, 1, 1], [3, 5, 9], [1, 3, 1], 5)]


def test_rows_of_many_pairs_are_cut(monkeypatch):
    monkeypatch.setattr(blocks, "ROW_PAIRS", 2)
    ends = {"cell": [0] * 3, "a_type": ["user"] * 3, "a_id": [1, 1, 2], "b_type": ["user"] * 3, "b_id": [4, 4, 3], "label": [1] * 3}
    packed = pa.Table.from_batches([blocks._packed(pa.table(ends)), blocks._packed(pa.table(ends | {"b_id": [5, 4, 3]}))])
    told = blocks._merged(packed.add_column(0, "round", pa.array([0, 0])).add_column(1, "slot", pa.array([7, 7])))
    assert [(r["slot"], r["a"], r["b"], r["times"], r["n"]) for r in told.to_pylist()] == [(7, [1, 1], [4, 5], [3, 1], 4), (7, [2], [3], [2], 2)]


def test_cells_of_a_round_take_different_buckets(spark):
    keys = blocks.slot_keys(spark, 5, 12)
    assert len(set(keys)) == len(keys) >= 12
    table = spark.createDataFrame([(k,) for k in keys[:10]], "slot long").repartition(5, "slot")
    assert sorted(r.n for r in table.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) == [2] * 5
