"""Tables bucketed and sorted by a key, found again by path in any session."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import shuffles_freed

def _name(path: str) -> str:
    return f"earshot_{hashlib.md5(path.encode()).hexdigest()}"


def _layout_path(path: str) -> str:
    return f"{path.rstrip('/')}-layout"


def write_bucketed(
    df: DataFrame,
    path: str,
    key: str,
    sort: Sequence[str] = (),
    buckets: int | None = None,
    partition: str | None = None,
    lasting: bool = True,
    dealt: bool = False,
) -> DataFrame:
    """Write the table in ``buckets`` buckets of ``key``, one sorted file each, and read it.

    By default there are as many as shuffle partitions, so that what is joined to the
    table is dealt to its buckets and the table stays where it is. ``partition`` parts
    it into folders first. The layout of a ``lasting`` table is written beside it, after
    it; others are known to this session only.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = list(sort) or [key]
    spark.sql(f"drop table if exists {_name(path)}")
    rows = df if dealt else df.repartition(buckets, key)
    writer = rows.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(*sort)
    if partition:
        writer = writer.partitionBy(partition)
    with shuffles_freed(spark):
        writer.saveAsTable(_name(path), format="parquet")
    if lasting:
        layout = json.dumps({"key": key, "sort": sort, "buckets": buckets, "partition": partition, "schema": df.schema.jsonValue()})
        spark.createDataFrame([(layout,)], "layout string").coalesce(1).write.mode("overwrite").parquet(_layout_path(path))
    return spark.table(_name(path))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_bucketed``: Spark knows that its rows lie by key, and joins and groups by it without a shuffle."""
    layout = json.loads(spark.read.parquet(_layout_path(path)).first().layout)
    schema = T.StructType.fromJson(layout["schema"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    sort = ", ".join(f"`{c}`" for c in layout["sort"])
    spark.sql(f"drop table if exists {_name(path)}")  # the files stay
    parts = f"partitioned by (`{layout['partition']}`) " if layout["partition"] else ""
    spark.sql(
        f"create table {_name(path)} ({columns}) using parquet {parts}"
        f"clustered by (`{layout['key']}`) sorted by ({sort}) into {layout['buckets']} buckets location '{path}'"
    )
    if layout["partition"]:
        spark.sql(f"msck repair table {_name(path)}")
    return spark.table(_name(path))


def hot_keys(df: DataFrame, key: str, share: float) -> list:
    """Keys with more than a share of all rows: at most 1 / share of them reach the driver."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).first().n or 0
    return sorted(r[0] for r in counts.where((F.col("_n") > share * total) & F.col(key).isNotNull()).select(key).collect())
