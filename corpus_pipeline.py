"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``documents``. Between stages the rows are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earshot.llm.common import stored, table
from earshot.llm.decontaminate import without_leaks
from earshot.llm.mixing import mixed_corpus
from earshot.llm.quality import keep_good
from earshot.llm.sharding import shard_documents
from earshot.llm.near_copies import without_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting rules reject go; a null or empty text is one of them. Equal texts share their verdict."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of equal ids and texts the first by all columns.

    Texts without words are copies of one another.
    """
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go; null texts hold none, null items stand nowhere."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand, whole, as often as the mix takes them.

    A null source is a source of its own, a text without words is never taken, and of
    equal rows on a cut as many are taken as fit.
    """
    return mixed_corpus(docs, whole=True)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix gets its shard and slot; copies stay together, null texts among them."""
    return shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]

# The vote model, hashed fingerprints and draws are beyond SQL; tests hold the
# stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
