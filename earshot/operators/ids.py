"""Dense numbering that never sorts a table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

BUCKET_ROWS = 200_000


def buckets_for(rows: int) -> int:
    return rows // BUCKET_ROWS + 1


def positions(df: DataFrame, order: Sequence[str], name: str, buckets: int | None = None) -> DataFrame:
    """Add the 0-based place of each row in the given order.

    Rows are dealt by ranges of the whole order, equal rows by a running number
    besides, so that no value is too frequent for a range; each range is sorted by
    itself and starts where the ranges before end. The ranges are staged, as Spark
    would draw others when asked again; one count per range reaches the driver.
    """
    if buckets is None:
        buckets = buckets_for(df.count())
    if buckets < 2:  # at most about BUCKET_ROWS rows, numbered without another pass
        one = Window.partitionBy(F.lit(0)).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(one) - 1).cast("long"))
    keys = [*order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = staged(dealt.drop("_tie").withColumns({"_range": F.spark_partition_id(), "_inside": inside}), "ranges")
    starts, total = [], 0
    for found, n in sorted(tuple(r) for r in dealt.groupBy("_range").count().collect()):
        starts.append((found, total))
        total += n
    table = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    placed = dealt.join(F.broadcast(table), "_range")  # one row per range
    return placed.withColumn(name, F.col("_start") + F.col("_inside")).drop("_range", "_inside", "_start")


def dense_ids(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """(raw_id, node_id): distinct ids numbered from 0 in their order."""
    ids = df.select(F.col(column).alias("raw_id")).where("raw_id is not null").distinct()
    return positions(ids, ["raw_id"], "node_id", buckets)


def remap(df: DataFrame, mapping: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Replace a raw id by its dense id; rows without one are dropped."""
    ids = mapping.select(F.col("raw_id").alias("_raw"), F.col("node_id").alias("_node"))
    joined = df.join(ids, F.col(column) == F.col("_raw"))
    name = name or column
    kept = [F.col(c) for c in df.columns if c != column and c != name]
    return joined.select(*kept, F.col("_node").alias(name))
