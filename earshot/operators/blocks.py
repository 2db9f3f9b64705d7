"""Skip-gram training in blocks: mini-batches without a join of pairs and vectors.

Nodes are dealt by hash to an even number of blocks. A cell is a pair of blocks, or a
block with itself, and holds the distinct training pairs between them with their
counts. An epoch has as many rounds as blocks: one for the blocks by themselves, the others
match the blocks as in a round-robin tournament, so the cells of a round share no
block and are trained at the same time, each in one task that has both blocks'
vectors and goes through the cell's pairs in mini-batches of Adagrad.

Pairs are counted and packed into arrays on their way to their cells, written once,
bucketed by cell, and stay where they are; a round moves the vectors to their cells, and
those of the round before are deleted. As repeated pairs are counted before, a very popular
node brings a cell one pair for each node of the other block at most. Blocks are as many as keep
``CELL_PAIRS`` pairs a cell and ``BLOCK_NODES`` nodes a block, about. Order and
batches follow from the pairs and the seed, so a lost task trains the same again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.buckets import write_bucketed
from ..sources.staging import staged, staging_dir, unstage

CELL_PAIRS = 2_000_000
BLOCK_NODES = 200_000
RUN_PAIRS = 1 << 20  # pairs that a task counts before it packs them
ROW_PAIRS = 1 << 17  # pairs in a row, at most
ENDS = ["a_type", "a_id", "b_type", "b_id"]
GROUP = ["cell", "a_type", "b_type", "label"]
PLACE = ["round", "slot"]
VECTORS = "node_type string, node_id long, vec array<double>, sq array<double>, block int"


def blocks_for(pairs: int, nodes: int) -> int:
    """One block while all fits one cell, else an even number."""
    if pairs <= CELL_PAIRS and nodes <= BLOCK_NODES:
        return 1
    return 2 * math.ceil(max(math.sqrt(2 * pairs / CELL_PAIRS), nodes / BLOCK_NODES, 2) / 2)


def rounds(blocks: int) -> list[list[tuple[int, int]]]:
    """The cells of each round: every two blocks, and each with itself, once; no block twice in a round."""
    found = [[(i, i) for i in range(blocks)]]
    ring = blocks - 1
    for r in range(ring if blocks > 1 else 0):
        pairs = [(r, ring)] + [((r + k) % ring, (r - k) % ring) for k in range(1, blocks // 2)]
        found.append([(min(p), max(p)) for p in pairs])
    return found


def _block(kind: str, node: str, blocks: int):
    return F.pmod(F.xxhash64(kind, node), F.lit(blocks)).cast("int")


def _flat(table: pa.Table, column: str) -> np.ndarray:
    """The elements of a list column, one after another."""
    return np.concatenate([np.empty(0, np.int64), *[chunk.flatten().to_numpy(zero_copy_only=False) for chunk in table[column].chunks]])


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, pa.int64()))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    found = column.combine_chunks().dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.any([np.diff(k) != 0 for k in keys], axis=0)
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def _packed(table: pa.Table) -> pa.RecordBatch:
    """Pairs a row as rows of distinct pairs (*GROUP, a, b, times), with the number n of all."""
    (kinds, names), (others, other_names), (labels, label_values) = (_codes(table[c]) for c in ("a_type", "b_type", "label"))
    cell = table["cell"].to_numpy()
    group = ((cell * len(names) + kinds) * len(other_names) + others) * len(label_values) + labels
    a, b = table["a_id"].to_numpy(), table["b_id"].to_numpy()
    order = np.lexsort((b, a, group))
    group, a, b = group[order], a[order], b[order]
    first = _starts_of(group, a, b)
    times = np.diff(np.append(first, len(order)))
    rows = _starts_of(group[first])
    at = order[first[rows]]
    told = [pa.array(cell[at]), names.take(pa.array(kinds[at])), other_names.take(pa.array(others[at])), label_values.take(pa.array(labels[at]))]
    n = np.add.reduceat(times, rows)
    return pa.RecordBatch.from_arrays([*told, *[_lists(x, rows) for x in (a[first], b[first], times)], pa.array(n)], names=[*GROUP, "a", "b", "times", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= RUN_PAIRS:
            yield _packed(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _packed(pa.Table.from_batches(held))


def _merged(table: pa.Table) -> pa.Table:
    """The rows of one cell, its types and label as one, cut where it has many pairs."""
    a, b, times = (_flat(table, c) for c in ("a", "b", "times"))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = _starts_of(a, b)
    a, b, times = a[first], b[first], np.add.reduceat(times[order], first)
    rows = np.arange(0, len(a), ROW_PAIRS)
    told = table.select([*PLACE, *GROUP]).take(pa.array(np.zeros(len(rows), np.int64)))
    for name, values in (("a", a), ("b", b), ("times", times)):
        told = told.append_column(name, _lists(values, rows))
    return told.append_column("n", pa.array(np.add.reduceat(times, rows)))


def slot_keys(spark: SparkSession, buckets: int, n: int) -> list[int]:
    """At least ``n`` numbers, that Spark deals to one bucket after the other: the cells of a round need not meet in one task."""
    n = max(n, buckets)
    dealt = spark.range(0, 20 * n, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket"))
    order = Window.partitionBy("bucket").orderBy("id")
    rows = dealt.select("id", "bucket", F.row_number().over(order).alias("turn")).where(F.col("turn") <= -(-n // buckets) + 1)
    return [r.id for r in sorted(rows.collect(), key=lambda r: (r.turn, r.bucket))]


def _slot(keys: Sequence[int], number: int, cells: int, k: int) -> int:
    """The slot of cell k of a round: others for the next round, to use all buckets."""
    return keys[(number * cells + k) % len(keys)]


def dealt_pairs(pairs: DataFrame, blocks: int, keys: Sequence[int] | None = None) -> DataFrame:
    """(*PLACE, *GROUP, a, b, times, n): distinct pairs of a cell, two types and a label in order, written once and bucketed by slot.

    ``a`` and ``b`` are arrays of node ids, ``times`` how often each pair stands, ``n`` their
    sum. A round's cells take different slots, numbers among ``keys`` (``slot_keys``).
    """
    spark = pairs.sparkSession
    keys = keys or range(blocks)
    at = [(i * blocks + j, r, _slot(keys, r, len(cells), k)) for r, cells in enumerate(rounds(blocks)) for k, (i, j) in enumerate(cells)]
    table = spark.createDataFrame(at, "cell long, round int, slot long")
    i, j = _block("a_type", "a_id", blocks), _block("b_type", "b_id", blocks)
    cell = (F.least(i, j) * blocks + F.greatest(i, j)).cast("long").alias("cell")
    group = f"cell long, a_type string, b_type string, label {pairs.schema['label'].dataType.simpleString()}"
    lists = "a array<long>, b array<long>, times array<long>, n long"
    ends = [F.col(c).cast("long" if c.endswith("_id") else "string").alias(c) for c in ENDS]
    known = pairs.dropna(subset=ENDS).select(cell, *ends, "label")  # no node is null
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = known.mapInArrow(_runs, f"{group}, {lists}").join(F.broadcast(table), "cell")  # one row a cell: blocks squared
    counted = runs.repartition(buckets, "slot").groupBy(*PLACE, *GROUP).applyInArrow(_merged, f"round int, slot long, {group}, {lists}")
    path = f"{staging_dir(spark)}/cells-{uuid.uuid4().hex}"
    return write_bucketed(counted, path, "slot", buckets=buckets, partition="round", lasting=False, dealt=True)


def trained_cell(vec: np.ndarray, sq: np.ndarray, a: np.ndarray, b: np.ndarray, label: np.ndarray, n: np.ndarray, rate: float, batch: int, order: np.ndarray) -> None:
    """One pass of Adagrad over pairs of rows of ``vec``, in place; a node moves by its mean gradient in the batch."""
    dim, part, last = vec.shape[1], np.arange(vec.shape[1]), np.empty(len(vec), np.int64)
    a, b, label, n = a[order], b[order], label[order], n[order]
    for k in range(0, len(order), batch):
        w = n[k : k + batch]
        ends = np.concatenate((a[k : k + batch], b[k : k + batch]))
        both = vec.take(ends, axis=0)
        va, vb = both[: len(w)], both[len(w) :]
        slope = (1 / (1 + np.exp(-np.einsum("ij,ij->i", va, vb))) - label[k : k + batch]) * w
        at = np.arange(len(ends))
        last[ends] = at
        place = last.take(ends)  # a node's sums stand at its last place in the batch
        one = np.flatnonzero(place == at)
        each = np.concatenate((slope[:, None] * vb, slope[:, None] * va))
        total = np.bincount((place[:, None] * dim + part).ravel(), each.ravel(), len(at) * dim).reshape(-1, dim)
        weight = np.bincount(place, np.concatenate((w, w)), len(at))
        rows, mean = ends[one], total[one] / weight[one, None]
        sums = sq.take(rows, axis=0) + mean * mean
        sq[rows] = sums
        vec[rows] = both[one] - rate * mean / np.sqrt(sums + 1e-12)


def _rows_of(vectors: pd.DataFrame):
    """Finds the rows of nodes in ``vectors``, sorted by type and id, by a search per type; -1 for unknown ones."""
    codes, kinds = pd.factorize(vectors["node_type"])
    ids = vectors["node_id"].to_numpy()
    first = np.searchsorted(codes, np.arange(len(kinds) + 1))  # types come in their order

    def rows(types: pd.Series, nodes: pd.Series) -> np.ndarray:
        told, names = pd.factorize(types)
        nodes, found = nodes.to_numpy(), np.full(len(nodes), -1, np.int64)
        for k, name in enumerate(names):
            at = kinds.get_indexer([name])[0] if len(kinds) else -1
            if at >= 0:
                of, mine = np.flatnonzero(told == k), ids[first[at] : first[at + 1]]
                place = np.minimum(np.searchsorted(mine, nodes[of]), len(mine) - 1)
                found[of] = np.where(mine[place] == nodes[of], first[at] + place, -1)
        return found

    return rows


def _typed(column: pa.ChunkedArray, times: np.ndarray | None = None) -> pd.Series:
    """A column of type names, in order of the names; each ``times`` times."""
    codes, names = _codes(column)
    codes = codes if times is None else np.repeat(codes, times)
    names = names.to_pylist()
    rank = np.argsort(np.argsort(names)) if names else np.empty(0, np.int64)
    return pd.Series(pd.Categorical.from_codes(rank[codes] if len(names) else codes, sorted(names)))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table[column].combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)


def _cell(rate: float, batch: int, seed: int):
    def work(vectors: pa.Table, pairs: pa.Table) -> pa.Table:
        kept = ["node_type", "node_id", "vec", "sq", "block"]
        if not vectors.num_rows or not pairs.num_rows:
            return vectors.select(kept)
        types, ids = _typed(vectors["node_type"]), vectors["node_id"].to_numpy()
        sort = np.lexsort((ids, types.cat.codes))
        vectors = vectors.select(kept).take(pa.array(sort))
        rows = _rows_of(pd.DataFrame({"node_type": types.iloc[sort].reset_index(drop=True), "node_id": ids[sort]}))
        times = pc.list_value_length(pairs["a"]).to_numpy()
        a = rows(_typed(pairs["a_type"], times), pd.Series(_flat(pairs, "a")))
        b = rows(_typed(pairs["b_type"], times), pd.Series(_flat(pairs, "b")))
        label, n = np.repeat(pairs["label"].to_numpy().astype(float), times), _flat(pairs, "times").astype(float)
        known = np.flatnonzero((a >= 0) & (b >= 0))  # pairs of unknown nodes train nothing
        known = known[np.lexsort((label[known], a[known] * vectors.num_rows + b[known]))]
        vec, sq = _matrix(vectors, "vec"), _matrix(vectors, "sq")
        order = known[np.random.default_rng([seed, pairs["cell"][0].as_py()]).permutation(len(known))]
        trained_cell(vec, sq, a, b, label, n, rate, batch, order)
        starts = pa.array(np.arange(0, vec.size + 1, vec.shape[1]), pa.int32())
        told = {"vec": vec, "sq": sq}
        return pa.table({c: pa.ListArray.from_arrays(starts, pa.array(told[c].ravel())) if c in told else vectors[c] for c in kept})

    return work


def trained_round(
    vectors: DataFrame, pairs: DataFrame, cells: list[tuple[int, int]], number: int, blocks: int, rate: float, batch: int, seed: int, keys: Sequence[int] | None = None
) -> DataFrame:
    """All vectors after the cells of one round; only vectors are shuffled. ``keys`` are those of ``dealt_pairs``."""
    home = {block: _slot(keys or range(blocks), number, len(cells), k) for k, cell in enumerate(cells) for block in cell}
    slot = F.get(F.array(*[F.lit(home[k]).cast("long") for k in range(blocks)]), F.col("block"))
    mine = vectors.withColumn("slot", slot).groupBy("slot")
    theirs = pairs.where(F.col("round") == number).select("slot", *GROUP, "a", "b", "times").groupBy("slot")
    return mine.cogroup(theirs).applyInArrow(_cell(rate, batch, seed), VECTORS)


def train_blocks(
    pairs: DataFrame, vectors: DataFrame, rate: float = 0.1, epochs: int = 5, batch: int = 512, seed: int = 5, blocks: int | None = None
) -> DataFrame:
    """(node_type, node_id, vec) after ``epochs`` passes over all pairs (a_type, a_id, b_type, b_id, label).

    ``vectors`` (node_type, node_id, vec) are where it starts. Each round is written once.
    """
    if blocks is None:
        blocks = blocks_for(pairs.count(), vectors.count())
    if blocks > 1 and blocks % 2:
        raise ValueError("one block or an even number")
    spark = pairs.sparkSession
    keys = slot_keys(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    dealt = dealt_pairs(pairs, blocks, keys)
    start = vectors.withColumn("sq", F.transform("vec", lambda _: F.lit(0.0)))
    now = staged(start.select("node_type", "node_id", "vec", "sq", _block("node_type", "node_id", blocks).alias("block")), "vectors")
    for epoch, number, cells in _schedule(epochs, blocks):
        before, now = now, staged(trained_round(now, dealt, cells, number, blocks, rate, batch, seed + epoch, keys), "vectors")
        unstage(before)
    return now.select("node_type", "node_id", "vec")


def _schedule(epochs: int, blocks: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    for epoch in range(epochs):
        for number, cells in enumerate(rounds(blocks)):
            yield epoch, number, cells
