"""Whole jobs from folder to folder: preprocess raw tables, build a graph, store and load it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import require_agreement
from ..operators.edges import Graph, identity_features, vector_features
from ..sources.raw import read_genre_dictionary, read_genre_lines, split_raw
from ..sources.staging import staged, staged_within
from ..sources.store import load_graph, read_vectors, write_by_artist, write_graph, write_table, write_vectors
from ..sources.versions import built, current, fingerprint
from .pipelines import KINDS, Tables, build_graph, clean_all, embed_graph, stage_tables, subset_users, union_all

# Files of a raw folder.
FILES = {"user": "users", "album": "albums", "artist": "artists", "track": "tracks", "le": "les"}
GENRE_LINES, GENRES = "artist_genres", "genres"
REJECTS, LINES = "rejects", "lines"  # tables of a cleaned folder: raw rows that were not read, and counts of lines


def preprocess(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    n_users: int | None = None,
    popular_sigmas: float | None = None,
    restrict_to_events: bool = False,
    seed: int = 17,
    overwrite: bool = False,
) -> Tables:
    """Clean a folder of raw tab-separated tables into a folder of Parquet tables, and read these.

    ``n_users`` draws a joint quota sample of so many users, ``popular_sigmas`` keeps
    popular artists only. Rows that cannot be read go to a table of rejects. Artists that
    differ between the written tables are an error, and nothing is published then. A
    folder with these options and this input is left as it is, one with others is an
    error unless ``overwrite`` is set.
    """

    def build(folder: str) -> None:
        parts = {kind: split_raw(spark, f"{raw_dir}/{name}", kind) for kind, name in FILES.items()}
        tables = {kind: part[0] for kind, part in parts.items()}
        users = None if n_users is None else staged(subset_users(tables["user"], n_users, seed), "subset")
        cleaned = clean_all(tables, users, popular_sigmas, restrict_to_events)
        counted = {k: write_by_artist(cleaned[k], f"{folder}/{k}", f"{k}_id") for k in ("artist", "album", "track")}
        require_agreement(counted["artist"]["rows"], counted["album"]["artists"], counted["track"]["artists"])
        for kind in ("le", "user"):
            write_table(cleaned[kind], f"{folder}/{kind}")
        write_table(union_all([part[1] for part in parts.values()]), f"{folder}/{REJECTS}")
        counts = [(kind, c["lines"], c["kept"], c["rejected"]) for kind, (*_, c) in parts.items()]
        write_table(spark.createDataFrame(counts, "kind string, n_lines long, n_kept long, n_rejected long").coalesce(1), f"{folder}/{LINES}")

    options = {"n_users": n_users, "popular_sigmas": popular_sigmas, "restrict_to_events": restrict_to_events, "seed": seed}
    with staged_within(spark):
        built(spark, out_dir, options | {"input": fingerprint(spark, raw_dir)}, build, overwrite)
    return clean_tables(spark, out_dir)


def clean_tables(spark: SparkSession, clean_dir: str, kinds: Sequence[str] = KINDS) -> Tables:
    """Tables of a cleaned folder; beside the usual ones there are ``REJECTS`` and ``LINES``."""
    found = current(spark, clean_dir)
    folder = clean_dir if found is None else found[0]
    return {kind: spark.read.parquet(f"{folder}/{kind}") for kind in kinds}


def build(
    spark: SparkSession,
    clean_dir: str,
    raw_dir: str,
    graph_dir: str,
    artists: bool = True,
    albums: bool = True,
    tracks: bool = True,
    weighted: bool = False,
    normalize: bool = False,
    embed: bool = True,
    dim: int = 8,
    length: int = 64,
    window: int = 7,
    per_node: int = 3,
    negatives: int = 10,
    rate: float = 0.1,
    epochs: int = 5,
    batch: int = 512,
    method: str = "blocks",
    overwrite: bool = False,
) -> tuple[Graph, DataFrame]:
    """The graph of a cleaned folder and its node features, stored and loaded again.

    Features are trained embeddings, or with ``embed`` off the ids themselves. A stored
    graph, and stored vectors, with the same options and input are read and not built
    again; with others they are an error, or built anew if ``overwrite`` is set. What is
    read is one whole build at any time, see ``versions``.
    """

    def write(folder: str) -> None:
        cleaned = stage_tables(clean_tables(spark, clean_dir))
        lines = read_genre_lines(spark, f"{raw_dir}/{GENRE_LINES}")
        genres = read_genre_dictionary(spark, f"{raw_dir}/{GENRES}")
        write_graph(build_graph(cleaned, lines, genres, artists, albums, tracks, weighted, normalize), folder)

    options = {"artists": artists, "albums": albums, "tracks": tracks, "weighted": weighted, "normalize": normalize}
    found = current(spark, clean_dir)
    inputs = {"input": fingerprint(spark, clean_dir if found is None else found[0])}
    inputs |= {f"input {name}": fingerprint(spark, f"{raw_dir}/{name}") for name in (GENRE_LINES, GENRES)}
    with staged_within(spark):
        folder = built(spark, f"{graph_dir}/graph", options | inputs, write, overwrite)
    graph = load_graph(spark, folder)
    if not embed:
        return graph, identity_features(graph.node_table())
    training = {"dim": dim, "length": length, "window": window, "per_node": per_node, "negatives": negatives}
    training |= {"rate": rate, "epochs": epochs, "batch": batch, "method": method, "graph": folder.rsplit("/", 1)[-1]}

    def train(path: str) -> None:
        write_vectors(embed_graph(graph, dim, length, window, per_node, negatives, rate, epochs, batch, method), path)

    with staged_within(spark):
        vectors = built(spark, f"{graph_dir}/vectors", training, train, overwrite)
    return graph, vector_features(graph.node_table(), read_vectors(spark, vectors), dim)


def raw_ids(graph: Graph, kinds: Sequence[str] | None = None) -> DataFrame:
    """(node_type, node_id, raw_id): what the nodes of a graph are called in the tables."""
    table = graph.node_table()
    return table if kinds is None else table.where(F.col("node_type").isin(*kinds))
