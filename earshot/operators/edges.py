"""Edges of the listening graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import Bitmap, number_marked
from .ids import positions
from .playcount import chronological, playcount, relative_playcount

# Relation -> (source type, destination type); reverses share edge ids.
RELATIONS = {
    "in_genre": ("artist", "genre"),
    "is_genre_of": ("genre", "artist"),
    "produced": ("artist", "album"),
    "produced_by": ("album", "artist"),
    "preformed_by": ("track", "artist"),
    "preformed": ("artist", "track"),
    "listened_to_artist": ("user", "artist"),
    "artist_listened_by": ("artist", "user"),
    "listened_to_album": ("user", "album"),
    "album_listened_by": ("album", "user"),
    "listened_to_track": ("user", "track"),
    "track_listened_by": ("track", "user"),
}
REVERSE = {
    "in_genre": "is_genre_of",
    "produced": "produced_by",
    "preformed_by": "preformed",
    "listened_to_artist": "artist_listened_by",
    "listened_to_album": "album_listened_by",
    "listened_to_track": "track_listened_by",
}


def reverse(edges: DataFrame) -> DataFrame:
    """The same edges the other way round, ids and attributes kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def genres_by_name(lines: DataFrame, artists: DataFrame) -> DataFrame:
    """(artist_id, genre_id) of genre lines; of artists with one name the largest id gets the genre."""
    owner = artists.groupBy("artist_name").agg(F.max("artist_id").alias("artist_id"))
    return lines.join(owner, "artist_name").select("artist_id", F.col("genre_id").cast("long").alias("genre_id"))


def genres_or_default(pairs: DataFrame, artists: DataFrame, genres: DataFrame) -> DataFrame:
    """``pairs`` and, for every artist without any, the last genre of the dictionary."""
    default = F.broadcast(genres.agg(F.max("genre_id").alias("genre_id")))  # one row
    without = artists.select("artist_id").distinct().join(pairs, "artist_id", "left_anti")
    return pairs.unionByName(without.join(default))


def structural_pairs(pairs: DataFrame, src: Bitmap | None, dst: Bitmap | None) -> DataFrame:
    """(src, dst) of raw id pairs in dense ids; an end without a bitmap is dense already."""
    for end, ids in (("src", src), ("dst", dst)):
        if ids is not None:
            pairs = number_marked(pairs, ids, end)
    return pairs.select("src", "dst")


def listen_edges(dense: DataFrame, buckets: int | None = None) -> DataFrame:
    """(src, dst, edge_id, ts): one edge per event, in order of time."""
    return chronological(dense, buckets).select(F.col("user").alias("src"), F.col("item").alias("dst"), "edge_id", "ts")


def weights(dense: DataFrame, normalize: bool = False) -> DataFrame:
    """(src, dst, weight): one pair per user and item, weight its plays or its share of them."""
    if normalize:
        rows = relative_playcount(dense).withColumnRenamed("share", "weight")
    else:
        rows = playcount(dense).withColumn("weight", F.col("plays").cast("double")).drop("plays")
    return rows.select(F.col("user").alias("src"), F.col("item").alias("dst"), "weight")


def weighted_edges(dense: DataFrame, normalize: bool = False, buckets: int | None = None) -> DataFrame:
    """(src, dst, edge_id, weight): ``weights`` numbered in order of (src, dst)."""
    return number_weights(weights(dense, normalize), buckets)


def number_weights(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    return positions(rows, ["src", "dst"], "edge_id", buckets).select("src", "dst", "edge_id", "weight")


def relations_of(artists: bool, albums: bool, tracks: bool) -> list[str]:
    """Relations of a graph with these item types; structural ones need artists."""
    if not (artists or albums or tracks):
        raise ValueError("a graph needs artists, albums or tracks")
    types = {"user"} | ({"artist", "genre"} if artists else set()) | ({"album"} if albums else set()) | ({"track"} if tracks else set())
    return [r for r, ends in RELATIONS.items() if set(ends) <= types]


class Lazy(Mapping):
    """Tables by name, each made when it is first asked for, and once."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self.makers = dict(sorted(makers.items()))
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


@dataclass
class Graph:
    """Tables of a typed graph; those of a ``Lazy`` mapping are made only where they are read.

    ``pairs`` are the edges without ids or attributes, where these need not be numbered first.
    """

    nodes: Mapping[str, DataFrame]  # node type -> (raw_id, node_id)
    edges: Mapping[str, DataFrame]  # relation -> (src, dst, edge_id, ...)
    pairs: Mapping[str, DataFrame] | None = None  # relation -> (src, dst)

    def ends(self) -> Mapping[str, DataFrame]:
        """Relations as (src, dst), and maybe more."""
        return self.edges if self.pairs is None else self.pairs

    def node_counts(self) -> DataFrame:
        parts = [d.select(F.lit(t).alias("node_type")) for t, d in self.nodes.items()]
        return reduce(DataFrame.union, parts).groupBy("node_type").agg(F.count("*").alias("n"))

    def edge_counts(self) -> DataFrame:
        parts = [d.select(F.lit(r).alias("relation")) for r, d in self.edges.items()]
        return reduce(DataFrame.union, parts).groupBy("relation").agg(F.count("*").alias("n"))

    def node_table(self) -> DataFrame:
        parts = [d.select(F.lit(t).alias("node_type"), "raw_id", "node_id") for t, d in self.nodes.items()]
        return reduce(DataFrame.union, parts)

    def validate(self) -> DataFrame:
        """(relation, bad_src, bad_dst): ends outside the node ids, per relation."""
        sizes = self.node_counts()  # one row per node type
        types = ((r, *RELATIONS[r]) for r in self.edges)
        table = sizes.sparkSession.createDataFrame(list(types), "relation string, src_type string, dst_type string")
        for end in ("src", "dst"):
            table = table.join(F.broadcast(sizes.toDF(f"{end}_type", f"n_{end}")), f"{end}_type", "left")
        parts = [d.select(F.lit(r).alias("relation"), "src", "dst") for r, d in self.ends().items()]  # no edge is numbered for it
        rows = reduce(DataFrame.union, parts).join(F.broadcast(table), "relation")
        bad = lambda end: F.col(f"n_{end}").isNull() | (F.col(end) < 0) | (F.col(end) >= F.col(f"n_{end}"))
        return rows.groupBy("relation").agg(*[F.count(F.when(bad(end), 1)).alias(f"bad_{end}") for end in ("src", "dst")])


def identity_features(nodes: DataFrame) -> DataFrame:
    """(node_type, node_id, feat): the dense id as a vector of one float."""
    return nodes.select("node_type", "node_id", F.array(F.col("node_id").cast("float")).alias("feat"))


def vector_features(nodes: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(node_type, node_id, feat) from embeddings; a node without one gets zeros."""
    joined = nodes.join(vectors, ["node_type", "node_id"], "left")
    return joined.select("node_type", "node_id", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("feat"))
