"""Metapath walks, their context pairs and negative walks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .csr import CHUNK, adjacency, hot_chunks
from .edges import RELATIONS

TASK_ROWS = 1 << 20  # nodes drawn by a task, about
LOOPS = {
    "track": ("listened_to_track", "track_listened_by"),
    "album": ("listened_to_album", "album_listened_by"),
    "artist": ("listened_to_artist", "in_genre", "is_genre_of", "artist_listened_by"),
}


def metapath(node_types: Sequence[str]) -> list[str]:
    """Relations of the closed chain from user to user for these node types: a loop per item type.

    Tracks come before albums if artists take part, after them otherwise.
    """
    order = ("track", "album", "artist") if "artist" in node_types else ("album", "track")
    path = [r for kind in order if kind in node_types for r in LOOPS[kind]]
    if not path:
        raise ValueError(f"no metapath for node types {sorted(node_types)}")
    check_chain(path)
    return path


def check_chain(path: Sequence[str]) -> None:
    """Each relation must start where the one before ends, and the last end where the first starts."""
    for a, b in zip(path, [*path[1:], path[0]], strict=True):
        if RELATIONS[a][1] != RELATIONS[b][0]:
            raise ValueError(f"{a} does not lead to {b}")


def draw(*parts: Column, seed: int) -> Column:
    """A 32-bit number from the md5 of the parts: the same on every run and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def walks(
    starts: DataFrame, edges: Mapping[str, DataFrame], path: Sequence[str], length: int, per_node: int, seed: int = 7
) -> DataFrame:
    """(walk_id, step, node_type, node_id) of walks of at most ``length`` steps from every start.

    ``starts`` has node_id, ``edges`` src and dst. Step i follows relation i modulo the
    path's length to a neighbour drawn by walk and step; a walk without neighbours ends.
    Adjacencies and each step are written once; a step moves the walkers only.
    """
    check_chain(path)
    near = adjacency(edges, path)
    copies = F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("copy")
    at = starts.select("node_id", copies).select((F.col("node_id") * per_node + F.col("copy")).alias("walk_id"), "node_id")
    out = [at.select("walk_id", F.lit(0).alias("step"), F.lit(RELATIONS[path[0]][0]).alias("node_type"), "node_id")]
    ahead = staged(at, "walk")
    walkers = ahead.count()
    for step in range(1, length + 1):
        relation = path[(step - 1) % len(path)]
        place = F.col("offset") + F.pmod(draw(F.col("walk_id"), F.lit(step), seed=seed), F.col("degree"))
        asked = near.starts(ahead, relation).select("walk_id", place.alias("place"))
        asked = asked.select("walk_id", F.expr(f"place div {CHUNK}").alias("chunk"), F.expr(f"cast(place % {CHUNK} as int)").alias("at"))
        asked = staged(asked, "asked")  # read for the hot chunks and again
        ahead = staged(near.taken(asked, relation, hot_chunks(asked, walkers)).withColumnRenamed("dst", "node_id"), "walk")
        kind = F.lit(RELATIONS[relation][1]).alias("node_type")
        out.append(ahead.select("walk_id", F.lit(step).alias("step"), kind, "node_id"))
    return reduce(DataFrame.union, out)


def walk_arrays(steps: DataFrame, *ids: str) -> DataFrame:
    """(*ids, nodes): each walk as one array of (node_type, node_id) in order of its steps."""
    ids = ids or ("walk_id",)
    nodes = F.sort_array(F.collect_list(F.struct("step", "node_type", "node_id")))
    return steps.groupBy(*ids).agg(F.transform(nodes, lambda n: F.struct(n["node_type"].alias("node_type"), n["node_id"].alias("node_id"))).alias("nodes"))


def _firsts(window: int, length: int) -> range:
    """Steps at which a full window of a walk of ``length`` steps starts."""
    return range(max(length + 2 - window, 0))


def contexts(arrays: DataFrame, window: int, length: int) -> DataFrame:
    """(*ids, step, apart, a_type, a_id, b_type, b_id): the first node of each full window with each other node.

    ``arrays`` holds a walk's ``nodes`` in one row; pairs are cut out of it there, by places
    that are the same for all walks and in compiled code.
    """
    ids = [c for c in arrays.columns if c != "nodes"]
    places = [(k, apart) for k in _firsts(window, length) for apart in range(1, window)]
    if not places:  # keeps the columns and no row
        arrays, places = arrays.limit(0), [(0, 0)]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(apart).alias("apart")) for k, apart in places])).alias("p")
    rows = arrays.select(*ids, "nodes", at).where(F.col("p.step") + F.col("p.apart") < F.size("nodes"))
    ends = {"a": F.get("nodes", F.col("p.step")), "b": F.get("nodes", F.col("p.step") + F.col("p.apart"))}
    names = [end[k].alias(f"{e}_{k.removeprefix('node_')}") for e, end in ends.items() for k in ("node_type", "node_id")]
    return rows.select(*ids, "p.step", "p.apart", *names)


def n_contexts(nodes: Column, window: int, length: int) -> Column:
    """How many rows ``contexts`` cuts out of a walk of so many nodes."""
    return reduce(Column.__add__, [F.greatest(F.lit(0), F.least(F.lit(window - 1), nodes - 1 - k)) for k in _firsts(window, length)], F.lit(0))


def _negatives(starts: DataFrame, counts: Mapping[str, int], path: Sequence[str], length: int, per_node: int, negatives: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(walk_id, start, negative) of each negative walk, and its steps' node types and their numbers of nodes.

    Starts are dealt by id to as many tasks as their walks need: a start makes ``per_node`` * ``negatives`` of them.
    """
    types = [RELATIONS[r][0] for r in path]
    tasks = counts.get(types[0], 0) * per_node * negatives * (length + 1) // TASK_ROWS + 1
    starts = starts.repartition(tasks, "node_id") if tasks > 1 else starts
    copies = F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("copy")
    ids = starts.select("node_id", copies).select((F.col("node_id") * per_node + F.col("copy")).alias("walk_id"), F.col("node_id").alias("start"))
    rows = ids.withColumn("negative", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))))
    return rows, [(types[k % len(types)], counts.get(types[k % len(types)], 0)) for k in range(length + 1)]


def _drawn(step: Column, n: Column, seed: int) -> Column:
    node = F.pmod(draw(F.col("walk_id"), F.col("negative"), step, seed=seed), n)
    return F.when(step == 0, F.col("start")).otherwise(node).cast("long").alias("node_id")


def negative_arrays(
    starts: DataFrame, counts: Mapping[str, int], path: Sequence[str], length: int, per_node: int, negatives: int, seed: int = 11
) -> DataFrame:
    """(walk_id, negative, nodes): the types of a walk with nodes drawn evenly from their type, one row a walk.

    The first node is the walk's own; the numbers of nodes per type are given.
    """
    rows, steps = _negatives(starts, counts, path, length, per_node, negatives)
    nodes = [F.struct(F.lit(t).alias("node_type"), _drawn(F.lit(k), F.lit(n).cast("long"), seed)) for k, (t, n) in enumerate(steps)]
    return rows.select("walk_id", "negative", F.array(*nodes).alias("nodes"))


def negative_walks(
    starts: DataFrame, counts: Mapping[str, int], path: Sequence[str], length: int, per_node: int, negatives: int, seed: int = 11
) -> DataFrame:
    """(walk_id, negative, step, node_type, node_id): ``negative_arrays`` a row a step."""
    rows, steps = _negatives(starts, counts, path, length, per_node, negatives)
    kinds = F.array(*[F.struct(F.lit(t).alias("node_type"), F.lit(n).cast("long").alias("n")) for t, n in steps])
    rows = rows.select("*", F.posexplode(kinds).alias("step", "kind"))
    return rows.select("walk_id", "negative", "step", "kind.node_type", _drawn(F.col("step"), F.col("kind.n"), seed))
