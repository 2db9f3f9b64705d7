"""Columns as float vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 4096  # of a one-hot column


def encode_identity(column: str) -> Column:
    return F.array(F.col(column).cast("float"))


def encode_categorical(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the one-hot vector over the column's sorted values; a missing value gives zeros.

    The values are a dimension of the vectors and collected, so more than ``MOST_VALUES`` are an error.
    """
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MOST_VALUES + 1).collect()
    if len(found) > MOST_VALUES:
        raise ValueError(f"{column} has more than {MOST_VALUES} values, too many for one-hot vectors; encode it as text")
    values = sorted(r[0] for r in found)
    hot = [F.when(F.col(column) == v, 1.0).otherwise(0.0).cast("float") for v in values]
    return df.withColumn(name, F.array(*hot))


def encode_text(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(id, vec): counts of a text's words in hashed buckets, scaled to length 1.

    Words are split at single spaces of the lower-cased text. Counts are summed per
    document before the vectors are formed; a text without words has a zero vector.
    """
    words = df.select(id_col, F.explode_outer(F.split(F.lower(text_col), " ")).alias("word"))
    hashed = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    bucket = F.when(F.col("word") != "", hashed)
    at = [F.sum(F.when(F.col("bucket") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in range(dim)]
    counts = words.select(id_col, bucket.alias("bucket")).groupBy(id_col).agg(*at)
    squares = F.lit(0.0)
    for k in range(dim):
        squares = squares + F.col(f"n{k}") * F.col(f"n{k}")
    norm = F.when(squares > 0, F.sqrt(squares)).otherwise(1.0)
    return counts.select(id_col, F.array(*[F.round(F.col(f"n{k}") / norm, 6) for k in range(dim)]).alias("vec"))
