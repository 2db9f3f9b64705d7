"""Composed jobs: cleaning, the demographic subset, the graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import cache, partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import clean as C
from ..operators import embed, walks
from ..operators.bitmaps import Bitmap, flag_marked, id_bitmaps, keep_marked
from ..operators.edges import (
    RELATIONS,
    REVERSE,
    Graph,
    Lazy,
    genres_by_name,
    genres_or_default,
    listen_edges,
    number_weights,
    relations_of,
    reverse,
    structural_pairs,
    weighted_edges,
    weights,
)
from ..operators.ids import buckets_for, dense_ids, positions
from ..operators.playcount import number_all, number_events, of_item, popular_artists, popularity
from ..operators.sampling import COUNTRIES, GENDERS, quota_sample
from ..sources.event_store import EventStore, write_events
from ..sources.staging import staged, staged_all, staged_within, staging_dir

Tables = dict[str, DataFrame]
ITEMS = ("artist", "album", "track")
KINDS = (*ITEMS, "le", "user")


def clean_all(
    tables: Tables,
    users: DataFrame | None = None,
    popular_sigmas: float | None = None,
    restrict_to_events: bool = False,
    kinds: Sequence[str] = KINDS,
) -> Tables:
    """Close typed tables (artist, album, track, le, user) under one another; give those of ``kinds``.

    One pass is enough: whether a row is named does not depend on the artists kept.
    ``users`` (user_id) makes a subset; ``popular_sigmas`` keeps artists that much
    above the mean; ``restrict_to_events`` keeps only entities that events name.
    Named entities are staged once; so are events if several tables depend on them.
    """
    names = staged_all({k: C.named(tables[k], f"{k}_id", f"{k}_name") for k in ITEMS})
    good = C.good_artist_ids(names["artist"], names["album"], names["track"])
    if popular_sigmas is not None:
        plays = staged(popularity(tables["artist"], tables["le"]), "plays")  # read for the cutoff and beside it
        good = C.keep_ids(good, popular_artists(plays, popular_sigmas), "artist_id")
    good = staged(good, "good-artists")  # read by every table below
    kept = {k: C.keep_ids(d, good, "artist_id") for k, d in names.items()}
    wanted = set(kinds)
    if wanted & {"le", "user"} or restrict_to_events:
        keys = {"artist_id": good, "album_id": kept["album"].select("album_id"), "track_id": kept["track"].select("track_id")}
        if users is not None:
            keys["user_id"] = users.select("user_id")
        events = C.filter_events(tables["le"], keys)
        if restrict_to_events or wanted >= {"le", "user"}:
            events = staged(events, "clean-le")
        if restrict_to_events:
            kept = {k: C.keep_ids(d, events.select(f"{k}_id"), f"{k}_id") for k, d in kept.items()}
        kept |= {"le": events, "user": C.fill_attributes(C.active_users(tables["user"], events))}
    return {k: kept[k] for k in kinds}


def subset_users(users: DataFrame, n: int, seed: int) -> DataFrame:
    """A joint quota sample of n users, or of as many as can be had."""
    return quota_sample(C.eligible(C.user_profile(users, list(COUNTRIES), list(GENDERS))), n, seed)


def stage_tables(cleaned: Tables, kinds: Sequence[str] = KINDS) -> Tables:
    """The cleaned tables written once; what follows reads them many times."""
    return staged_all({k: cleaned[k] for k in kinds})


def numbered(cleaned: Tables, kind: str) -> DataFrame:
    """Dense ids of a staged table; its row count is read off the files."""
    return dense_ids(cleaned[kind], f"{kind}_id", buckets_for(cleaned[kind].count()))


def marked_ids(cleaned: Tables, kinds: Sequence[str]) -> dict[str, Bitmap]:
    """The ids of staged tables as bitmaps, which number them as ``numbered`` does."""
    return id_bitmaps({k: cleaned[k].select(f"{k}_id") for k in kinds})


def build_graph(
    cleaned: Tables,
    genre_lines: DataFrame,
    genres: DataFrame,
    artists: bool = True,
    albums: bool = True,
    tracks: bool = True,
    weighted: bool = False,
    normalize: bool = False,
    relations: Sequence[str] | None = None,
) -> Graph:
    """A graph with the given item types, of all its relations or the named ones.

    ``cleaned`` should be staged: relations read the same tables. Node ids and relations
    are made where they are read; edges are numbered through bitmaps, without a shuffle
    before that of their own order.
    """
    wanted, kinds = _wanted(artists, albums, tracks, relations)
    marked = cache(lambda: marked_ids(cleaned, kinds))
    nodes = {k: lambda k=k: staged(numbered(cleaned, k), f"ids-{k}") for k in kinds}
    if artists:
        nodes["genre"] = lambda: genres.select(F.col("genre_id").alias("raw_id"), F.col("genre_id").alias("node_id"))

    def structural(relation: str) -> DataFrame:
        pairs = _structural(cleaned, genre_lines, genres, {relation})[relation]
        return structural_pairs(pairs, *(marked().get(kind) for kind in RELATIONS[relation]))

    def placed(relation: str) -> DataFrame:
        table = {"in_genre": "artist", "produced": "album", "preformed_by": "track"}[relation]
        return positions(structural(relation), ["src", "dst"], "edge_id", buckets_for(cleaned[table].count()))

    def heard(item: str) -> DataFrame:
        if len(items) < 2:
            return number_events(cleaned["le"], marked()["user"], marked()[item], item)
        return of_item(events(), item)

    @cache
    def events() -> DataFrame:
        """All events numbered, written once: every relation reads its columns, several times to be ordered."""
        return staged(number_all(cleaned["le"], marked()["user"], {k: marked()[k] for k in items}), "numbered")

    def listened(item: str) -> DataFrame:
        buckets = buckets_for(cleaned["le"].count())
        if not weighted:
            return listen_edges(heard(item), buckets)
        if len(items) < 2:
            return weighted_edges(heard(item), normalize, buckets)
        return number_weights(store().by_user(lambda events: weights(of_item(events, item), normalize)), buckets)

    @cache
    def store() -> EventStore:
        """All events numbered, by user: shuffled once for all relations."""
        rows = events()
        return write_events(rows, f"{staging_dir(rows.sparkSession)}/events-{uuid.uuid4().hex}", "user", "ts")

    between = [r for r in ("in_genre", "produced", "preformed_by") if r in wanted]
    items = [k for k in ITEMS if f"listened_to_{k}" in wanted]
    ways = {r: partial(placed, r) for r in between} | {f"listened_to_{k}": partial(listened, k) for k in items}
    ends = {r: partial(structural, r) for r in between}
    ends |= {f"listened_to_{k}": lambda k=k: heard(k).toDF("src", "dst", "ts").select("src", "dst") for k in items}
    return Graph(Lazy(nodes), _both_ways(ways), None if weighted else _both_ways(ends))


def _both_ways(forward: dict[str, Callable[[], DataFrame]]) -> Lazy:
    """Relations and their backward ones."""
    made = Lazy(forward)
    back = {REVERSE[r]: lambda r=r: reverse(made[r]) for r in forward}
    return Lazy({r: lambda r=r: made[r] for r in forward} | back)


def _wanted(artists: bool, albums: bool, tracks: bool, relations: Sequence[str] | None) -> tuple[set[str], list[str]]:
    """Relations, backward ones with their forward ones, and the node types but genres."""
    wanted = set(relations_of(artists, albums, tracks) if relations is None else relations)
    wanted |= {r for r, back in REVERSE.items() if back in wanted}
    kinds = ["user", *(k for k, on in (("artist", artists), ("album", albums), ("track", tracks)) if on)]
    if relations is not None:
        kinds = [k for k in kinds if any(k in RELATIONS[r] for r in wanted)]
    return wanted, kinds


def _structural(cleaned: Tables, genre_lines: DataFrame, genres: DataFrame, wanted: set[str]) -> dict[str, DataFrame]:
    """(src, dst) in raw ids of the asked relations between entities."""
    found: dict[str, DataFrame] = {}
    if "in_genre" in wanted:
        artists = cleaned["artist"]
        found["in_genre"] = genres_or_default(genres_by_name(genre_lines, artists), artists, genres).toDF("src", "dst")
    if "produced" in wanted:
        found["produced"] = cleaned["album"].select(F.col("artist_id").alias("src"), F.col("album_id").alias("dst"))
    if "preformed_by" in wanted:
        found["preformed_by"] = cleaned["track"].select(F.col("track_id").alias("src"), F.col("artist_id").alias("dst"))
    return found


def count_nodes(cleaned: Tables, genres: DataFrame, kinds: Sequence[str] = ("user", *ITEMS)) -> DataFrame:
    """(node_type, n) of the graph, without numbering a node; events are not read here."""
    ids = {k: cleaned[k].select(f"{k}_id").where(f"{k}_id is not null").distinct() for k in kinds}
    if "artist" in kinds:
        ids["genre"] = genres
    return union_all([d.select(F.lit(k).alias("node_type")) for k, d in ids.items()]).groupBy("node_type").agg(F.count("*").alias("n"))


def count_edges(
    cleaned: Tables,
    genre_lines: DataFrame,
    genres: DataFrame,
    artists: bool = True,
    albums: bool = True,
    tracks: bool = True,
) -> DataFrame:
    """(relation, n) of the event graph, without numbering a node or an edge.

    Ends are held against bitmaps of the cleaned tables' ids; events are read once
    for all relations.
    """
    wanted, kinds = _wanted(artists, albums, tracks, None)
    known = marked_ids(cleaned, kinds)
    parts = []
    for relation, pairs in _structural(cleaned, genre_lines, genres, wanted).items():
        for end, kind in zip(("src", "dst"), RELATIONS[relation], strict=True):
            if kind in known:
                pairs = keep_marked(pairs, known[kind], end)
        parts.append(pairs.select(F.lit(relation).alias("relation")))
    items = [k for k in ITEMS if f"listened_to_{k}" in wanted]
    heard = keep_marked(cleaned["le"].select("user_id", *[f"{k}_id" for k in items]), known["user"], "user_id")
    for k in items:
        heard = flag_marked(heard, known[k], f"{k}_id", f"_{k}")
    parts.append(heard.select(F.explode(F.array(*[F.when(F.col(f"_{k}"), f"listened_to_{k}") for k in items])).alias("relation")).where("relation is not null"))
    counts = union_all(parts).groupBy("relation").agg(F.count("*").alias("n"))
    # a relation without edges counts as none, and each backward relation as its forward one
    names = cleaned["le"].sparkSession.createDataFrame([(r, back) for r, back in REVERSE.items() if r in wanted], "forward string, back string")
    both = F.broadcast(names).join(counts, F.col("forward") == F.col("relation"), "left")
    n = F.coalesce("n", F.lit(0))
    return both.select(F.explode(F.array("forward", "back")).alias("relation"), n.alias("n")).where("n > 0")


def _path(graph: Graph) -> list[str]:
    return walks.metapath([t for t in graph.nodes if t in walks.LOOPS])


def walk_rows(graph: Graph, length: int, per_node: int) -> DataFrame:
    """(walk_id, nodes): metapath walks from every user, staged; adjacencies and steps are deleted."""
    starts, path = graph.nodes["user"].select("node_id"), _path(graph)
    edges = {r: graph.ends()[r] for r in path}  # what these stage is the graph's
    spark = starts.sparkSession
    folder = staging_dir(spark)
    with staged_within(spark):
        return staged(walks.walk_arrays(walks.walks(starts, edges, path, length, per_node)), "walks", folder)


def embedding_pairs(graph: Graph, length: int, window: int, per_node: int, negatives: int) -> tuple[DataFrame, int, int]:
    """(a_type, a_id, b_type, b_id, label): context pairs of walks, and of negative walks; their number and that of nodes.

    Nothing but walks is written for them, nor are they made to be counted.
    """
    counts = {r.node_type: r.n for r in graph.node_counts().collect()}
    starts = graph.nodes["user"].select("node_id")
    kept = ["a_type", "a_id", "b_type", "b_id"]
    walked = walk_rows(graph, length, per_node)
    real = walks.contexts(walked, window, length).select(*kept, F.lit(1).alias("label"))
    drawn = walks.negative_arrays(starts, counts, _path(graph), length, per_node, negatives)
    n = walks.n_contexts(F.size("nodes").cast("long"), window, length)
    n_real = walked.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first().n
    each = walked.sparkSession.range(1).select(walks.n_contexts(F.lit(length + 1), window, length).alias("n")).first().n
    n_drawn = counts.get("user", 0) * per_node * negatives * each
    drawn = walks.contexts(drawn, window, length).select(*kept, F.lit(0).alias("label"))
    return real.unionByName(drawn), n_real + n_drawn, sum(counts.values())


def embed_graph(
    graph: Graph,
    dim: int = 8,
    length: int = 64,
    window: int = 7,
    per_node: int = 3,
    negatives: int = 10,
    rate: float = 0.1,
    epochs: int = 5,
    batch: int = 512,
    method: str = "blocks",
) -> DataFrame:
    """(node_type, node_id, vec) of every node, trained on metapath walks.

    ``method``: ``blocks`` trains with negative walks in mini-batches of ``batch`` pairs;
    ``joins`` with the mean gradient of all pairs at once; ``word2vec`` with hierarchical
    softmax, for small graphs, where a node on no walk has no vector.
    """
    if method == "word2vec":
        return embed.train_word2vec(walk_rows(graph, length, per_node), dim, window, epochs)
    if method not in ("blocks", "joins"):
        raise ValueError(f"unknown method: {method!r}")
    pairs, n_pairs, n_nodes = embedding_pairs(graph, length, window, per_node, negatives)
    nodes = graph.node_table().select("node_type", "node_id")
    if method == "joins":
        return embed.train(staged(pairs, "pairs"), nodes, dim, rate, epochs, cut=lambda df: staged(df, "vectors"))
    return B.train_blocks(pairs, embed.start_vectors(nodes, dim), rate, epochs, batch, blocks=B.blocks_for(n_pairs, n_nodes))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
