"""Writers and readers of cleaned tables, graphs and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.edges import REVERSE, Graph, reverse


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a cleaned table as Parquet or as tab-separated text with a header, over what was there."""
    if form == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif form == "tsv":
        df.write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"')
    else:
        raise ValueError(f"unknown form: {form!r}")


def write_by_artist(df: DataFrame, path: str, key: str) -> dict[str, int]:
    """Write a cleaned entity table sorted by artist; (rows, artists) as the write itself has counted them."""
    seen = Observation()
    by = Window.partitionBy("artist_id").orderBy(key)
    first = df.withColumn("_first", F.row_number().over(by) == 1)
    counts = first.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_first"), 1)).alias("artists"))
    counts.drop("_first").write.mode("overwrite").parquet(path)
    return dict(seen.get)


def exists(spark: SparkSession, path: str) -> bool:
    """Can a Parquet table be read at the path? Works on any store that Spark reads."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def write_edges(edges: dict[str, DataFrame], path: str) -> None:
    """All relations in one table, a folder each."""
    for relation, df in edges.items():
        df.write.mode("overwrite").parquet(f"{path}/relation={relation}")


def read_edges(spark: SparkSession, path: str, relations: Sequence[str] | None = None) -> DataFrame:
    """Edges of the asked relations; only their folders are read."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    return found if relations is None else found.where(F.col("relation").isin(*relations))


def write_graph(graph: Graph, path: str) -> None:
    """Node ids, edges and counts of a graph; the table of counts comes last and marks it complete."""
    nodes = {kind: df.select("raw_id", "node_id") for kind, df in graph.nodes.items()}
    for kind, df in nodes.items():
        df.write.mode("overwrite").parquet(f"{path}/nodes/node_type={kind}")
    forward = {r: df for r, df in graph.edges.items() if r not in REVERSE.values()}
    write_edges(forward, f"{path}/edges")
    spark = next(iter(graph.nodes.values())).sparkSession
    counts = Graph(
        {k: spark.read.parquet(f"{path}/nodes/node_type={k}") for k in nodes},
        {r: spark.read.parquet(f"{path}/edges/relation={r}") for r in forward},
    )
    parts = [("node", counts.node_counts()), ("edge", counts.edge_counts() if forward else None)]
    tables = [df.toDF("name", "n").select(F.lit(part).alias("part"), "name", "n") for part, df in parts if df is not None]
    reduce(DataFrame.union, tables).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def graph_counts(spark: SparkSession, path: str) -> DataFrame:
    """(part, name, n) of a stored graph: rows per node type and per forward relation."""
    return spark.read.parquet(f"{path}/counts")


def load_graph(spark: SparkSession, path: str) -> Graph:
    """A stored graph; its tables are read only where used. Backward relations are turned edges."""
    names: dict[str, list[str]] = {"node": [], "edge": []}
    for row in graph_counts(spark, path).collect():  # one row per node type and relation
        names[row.part].append(row.name)
    nodes = {k: spark.read.parquet(f"{path}/nodes/node_type={k}") for k in sorted(names["node"])}
    edges = {r: spark.read.parquet(f"{path}/edges/relation={r}") for r in names["edge"]}
    edges |= {REVERSE[r]: reverse(df) for r, df in list(edges.items())}
    return Graph(nodes, {r: edges[r] for r in sorted(edges)})


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
    """The table at the path, built and written first if it is missing or to be overwritten."""
    if overwrite or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Embeddings (node_type, node_id, vec), a folder per node type."""
    vectors.write.mode("overwrite").partitionBy("node_type").parquet(path)


def read_vectors(spark: SparkSession, path: str, node_type: str | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if node_type is None else found.where(F.col("node_type") == node_type)
