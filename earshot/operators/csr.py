"""Adjacency in compressed rows, so that a step of a walk moves walkers only.

The edges of a relation are placed in order of (src, dst); a node's edges are the
``degree`` places from its ``offset`` on. Places are cut into chunks of ``CHUNK``, one row
each with the ends of its edges as an array, and a hub's edges are many chunks. A step
is two look-ups: of the walker's node among the offsets, and of the place drawn among the
chunks. Walkers are far fewer than edges, so edges are shuffled once, into their
order; what is moved after that are chunks. The chunk table lies in buckets: Spark
deals the walkers to them and reads the table where it is.

A chunk that very many walkers ask for at once (a popular node with few edges) is
broadcast to them; there are at most as many such chunks as walkers are to ``HOT`` ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.buckets import write_bucketed
from ..sources.staging import staged, staged_within, staging_dir
from .ids import positions

CHUNK = 1024  # edges
CODE_SHIFT = 52  # bits of a dense id; the relation's number stands above them
HOT = 200_000  # walkers that ask for one chunk
HOT_SHARE = 0.005  # and their share of all walkers, at least


def _runs(size: int):
    """Rows (key, dst, place) as runs of neighbouring places of one relation and chunk: (code, chunk, first, dsts)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, dst, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "dst", "place"))
            if not len(key):
                continue
            order = np.argsort(place, kind="stable")  # as they come, but where a batch spans two files
            key, dst, place = key[order], dst[order], place[order]
            code, chunk = (key >> CODE_SHIFT).astype(np.int32), place // size
            new = (np.diff(place) != 1) | (np.diff(chunk) != 0) | (np.diff(code) != 0)
            first = np.concatenate(([0], np.flatnonzero(new) + 1))
            dsts = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(dst, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[first]), pa.array(chunk[first]), pa.array(place[first]), dsts], names=["code", "chunk", "first", "dsts"]
            )

    return cut


@dataclass
class Adjacency:
    """The relations of a path: ``offsets`` (relation, node, offset, degree) and ``chunks`` (relation, chunk, ends).

    ``ends`` are the dst of a chunk's edges, null before the first of the relation. Places
    count through all relations.
    """

    offsets: DataFrame
    chunks: DataFrame

    def starts(self, nodes: DataFrame, relation: str) -> DataFrame:
        """``nodes`` (node_id, ...) that have edges of the relation, with their offset and degree."""
        table = self.offsets.where(F.col("relation") == relation).select(F.col("node").alias("_node"), "offset", "degree")
        return nodes.join(table, F.col("node_id") == F.col("_node")).drop("_node")

    def taken(self, asked: DataFrame, relation: str, hot: Sequence[int] = ()) -> DataFrame:
        """Walkers (walk_id, chunk, at) with the end of the edge they take: (walk_id, dst)."""
        table = self.chunks.where(F.col("relation") == relation).select(F.col("chunk").alias("_chunk"), "ends")
        parts = [(asked, table)]
        if hot:
            common = F.col("chunk").isin(*hot)
            few = F.broadcast(table.where(F.col("_chunk").isin(*hot)))  # at most 1 / HOT_SHARE rows
            parts = [(asked.where(~common), table), (asked.where(common), few)]
        edge = F.get("ends", F.col("at"))
        found = [a.join(t, F.col("chunk") == F.col("_chunk")).select("walk_id", edge.alias("dst")) for a, t in parts]
        return reduce(DataFrame.union, found)


def adjacency(edges: Mapping[str, DataFrame], path: Sequence[str]) -> Adjacency:
    """The adjacency along a closed path in which no relation comes twice, of all relations in one go.

    Which of several equal edges comes first does not matter, so edges need no ids.
    """
    if len(set(path)) != len(path):
        raise ValueError("a relation stands twice in the path")
    # dense ids leave room for the relation's number; one long sorts faster than a name and an id
    key = lambda k: (F.lit(k << CODE_SHIFT) + F.col("src")).alias("key")
    rows = reduce(DataFrame.union, [edges[r].select(key(k), F.col("dst").cast("long").alias("dst")) for k, r in enumerate(path)])
    spark = rows.sparkSession
    kept = staging_dir(spark)
    with staged_within(spark):  # the edges in their order are only needed until chunks are cut
        placed = positions(staged(rows, "pairs"), ["key", "dst"], "place")
        names = F.array(*[F.lit(r) for r in path])
        named = F.get(names, F.shiftright("key", CODE_SHIFT).cast("int")).alias("relation")
        offsets = placed.groupBy("key").agg(F.min("place").alias("offset"), F.count("*").alias("degree"))
        node = F.col("key").bitwiseAND(F.lit((1 << CODE_SHIFT) - 1)).alias("node")
        offsets = staged(offsets.select(named, node, "offset", "degree"), "offsets", kept)
        runs = placed.select("key", "dst", "place").mapInArrow(_runs(CHUNK), "code int, chunk long, first long, dsts array<long>")
        in_order = F.sort_array(F.collect_list(F.struct("first", "dsts")))
        chunks = runs.groupBy("code", "chunk").agg(in_order.alias("runs"))  # at most CHUNK edges
        # the first chunk of a relation starts inside: its ends are shifted to their place
        gap = F.array_repeat(F.lit(None).cast("long"), F.expr(f"cast(runs[0].first % {CHUNK} as int)"))
        ends = F.concat(gap, F.flatten("runs.dsts")).alias("ends")
        chunks = chunks.select(F.get(names, F.col("code")).alias("relation"), "chunk", ends)
        return Adjacency(offsets, write_bucketed(chunks, f"{kept}/chunks-{uuid.uuid4().hex}", "chunk", partition="relation", lasting=False))


def hot_chunks(asked: DataFrame, walkers: int) -> list[int]:
    """Chunks that a large share of very many walkers ask for; ``walkers`` is how many there are at most."""
    if walkers <= HOT:
        return []
    counts = asked.groupBy("chunk").agg(F.count("*").alias("n"))
    return [r.chunk for r in counts.where(F.col("n") > max(HOT, HOT_SHARE * walkers)).collect()]
