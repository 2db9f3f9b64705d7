"""Skip-gram embeddings with negative samples, as joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .walks import draw

NODE = ("node_type", "node_id")


def start_vectors(nodes: DataFrame, dim: int, seed: int = 3) -> DataFrame:
    """(node_type, node_id, vec): small vectors drawn from the node's name."""
    parts = [
        ((F.pmod(draw(F.col("node_type"), F.col("node_id"), F.lit(k), seed=seed), F.lit(2001)) - 1000) / 1000.0 / dim)
        for k in range(dim)
    ]
    return nodes.select(*NODE, F.array(*parts).alias("vec"))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scored(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (a_type, a_id, b_type, b_id, label) with their vectors and the model's probability."""
    a = vectors.select(F.col("node_type").alias("a_type"), F.col("node_id").alias("a_id"), F.col("vec").alias("a_vec"))
    b = vectors.select(F.col("node_type").alias("b_type"), F.col("node_id").alias("b_id"), F.col("vec").alias("b_vec"))
    both = pairs.join(a, ["a_type", "a_id"]).join(b, ["b_type", "b_id"])
    return both.withColumn("p", 1.0 / (1.0 + F.exp(-_dot("a_vec", "b_vec"))))


def sgns_loss(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: the mean logistic loss over all pairs."""
    p = F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return scored(pairs, vectors).agg(F.avg(-F.log(p)).alias("loss"))


def _mean_gradients(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(node_type, node_id, d0, d1, ...): the mean gradient of each node's pairs.

    Gradients are summed per node and component before the shuffle.
    """
    rows = scored(pairs, vectors).withColumn("g", F.col("p") - F.col("label"))
    ends = F.explode(
        F.array(
            F.struct(F.col("a_type").alias("node_type"), F.col("a_id").alias("node_id"), F.col("b_vec").alias("other")),
            F.struct(F.col("b_type").alias("node_type"), F.col("b_id").alias("node_id"), F.col("a_vec").alias("other")),
        )
    )
    parts = rows.select("g", ends.alias("e")).select("e.node_type", "e.node_id", *[(F.col("g") * F.get("e.other", F.lit(k))).alias(f"d{k}") for k in range(dim)])
    return parts.groupBy(*NODE).agg(*[F.avg(f"d{k}").alias(f"d{k}") for k in range(dim)])


def sgns_step(pairs: DataFrame, vectors: DataFrame, dim: int, rate: float) -> DataFrame:
    """Vectors after one step against the mean gradient of each node's pairs."""
    joined = vectors.join(_mean_gradients(pairs, vectors, dim), list(NODE), "left")
    moved = [F.get("vec", F.lit(k)) - rate * F.coalesce(F.col(f"d{k}"), F.lit(0.0)) for k in range(dim)]
    return joined.select(*NODE, F.array(*moved).alias("vec"))


def adagrad_step(pairs: DataFrame, vectors: DataFrame, dim: int, rate: float) -> DataFrame:
    """(node_type, node_id, vec, sq) after a step scaled, per component, by the root of its squared gradients so far."""
    told = vectors.join(_mean_gradients(pairs, vectors.select(*NODE, "vec"), dim), list(NODE), "left")
    slope = [F.coalesce(F.col(f"d{k}"), F.lit(0.0)) for k in range(dim)]
    sq = [F.get("sq", F.lit(k)) + slope[k] * slope[k] for k in range(dim)]
    moved = [F.get("vec", F.lit(k)) - rate * slope[k] / F.sqrt(sq[k] + 1e-12) for k in range(dim)]
    return told.select(*NODE, F.array(*moved).alias("vec"), F.array(*sq).alias("sq"))


def train(
    pairs: DataFrame, nodes: DataFrame, dim: int, rate: float = 0.1, epochs: int = 5, batches: int = 1, seed: int = 5, cut=None
) -> DataFrame:
    """(node_type, node_id, vec) after ``epochs`` passes of Adagrad over ``batches`` batches drawn by hash.

    A step scales with each component's own gradients, so ``rate`` is about how far
    a component moves at first, however many pairs a node has.
    """
    vectors = start_vectors(nodes, dim).withColumn("sq", F.array_repeat(F.lit(0.0), dim))
    batch = F.pmod(draw(F.col("a_type"), F.col("a_id"), F.col("b_type"), F.col("b_id"), F.col("label"), seed=seed), F.lit(batches))
    dealt = pairs.withColumn("_batch", batch)
    for _ in range(epochs):
        for k in range(batches):
            vectors = adagrad_step(dealt.where(F.col("_batch") == k).drop("_batch"), vectors, dim, rate)
            if cut is not None:
                vectors = cut(vectors)
    return vectors.select(*NODE, "vec")


MOST_WORDS = 1_000_000  # nodes that hierarchical softmax takes: vectors and tree are whole on the driver


def train_word2vec(arrays: DataFrame, dim: int, window: int = 5, epochs: int = 5, rate: float = 0.025, seed: int = 5, most: int = MOST_WORDS) -> DataFrame:
    """(node_type, node_id, vec) of the nodes on walks (``nodes``), by skip-gram with hierarchical softmax.

    For small graphs: Spark ML keeps all vectors on the driver and sends them to every
    task, so more than ``most`` different nodes are refused.
    """
    from pyspark.ml.feature import Word2Vec

    words = arrays.select(F.transform("nodes", lambda n: F.concat_ws(":", n["node_type"], n["node_id"].cast("string"))).alias("words"))
    n = words.select(F.explode("words").alias("w")).distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} nodes: train in blocks instead")
    model = Word2Vec(vectorSize=dim, minCount=0, windowSize=window, maxIter=epochs, stepSize=rate, seed=seed, inputCol="words").fit(words)
    from pyspark.ml.functions import vector_to_array

    found = model.getVectors().select(F.split("word", ":").alias("w"), vector_to_array("vector").alias("vec"))
    return found.select(F.get("w", F.lit(0)).alias("node_type"), F.get("w", F.lit(1)).cast("long").alias("node_id"), "vec")
