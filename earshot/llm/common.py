"""What the operators share: exact column choice, lineage cuts and stable digests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six code points that the contracts call white space.
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Keep the named columns, by exact case, whatever else the table holds.

    Extra columns may repeat a name in another case, which a plain ``select``
    calls ambiguous; going through positions avoids that.
    """
    columns = df.columns
    by_place = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return by_place.select(*[F.col(f"c{columns.index(n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, one process on one machine makes a folder of its own; on a
    cluster that would lose rows and is an error.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = found or tempfile.mkdtemp(prefix="earshot-")
        context.setCheckpointDir(found)
    return found


def staging_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/earshot-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Delete all that this application has stored; results that still read it are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table in the shared folder and read it back: a columnar lineage cut.

    Columns are written by position, as names may differ in case only.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{what}-{uuid.uuid4().hex}"
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    flat.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(flat.schema).parquet(path).toDF(*df.columns)


def dealt(df: DataFrame) -> DataFrame:
    """The table as a side of a join that is shuffled, whatever size Spark takes it for.

    Spark takes what Python or ``explode`` makes of a row to be as large as the row, and a
    file to be as large as it is compressed, so it may broadcast tables through the
    driver that are many times its limit.
    """
    return df.hint("merge")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: Column) -> Column:
    return F.encode(F.coalesce(column, F.lit("")), "UTF-8")
