"""Sets of integer ids as compressed bitmaps: filters and dense ids of events without a shuffle.

A row holds the ids of one bucket of ``BUCKET`` neighbouring ids: words of 64 bits, of which
empty ones at both ends are left out, and beside each word the number of smaller ids in
the whole set. An id is in the set if its bit is set; its dense id, the place among the
set's ids in order, is the number beside its word and the bits below its own. Both are
arithmetic on one row, so a table of events is filtered by several keys, and numbered, in
one pass over it while the bitmaps are broadcast.

Where ids lie close together a bitmap takes about two bits an id, so ``MOST_BYTES`` hold some
hundred million ids; where they are scattered, some hundred bytes an id. A bitmap's size is known
once it is written. A larger one is joined by bucket, which shuffles the events once.

Spark's own numbering of bitmap buckets turns the order round below zero and takes 4 KB
for a lone id, so words are put together by ``bit_or`` here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

WORDS = 16  # of a bucket
BUCKET = 64 * WORDS  # ids
MOST_BYTES = 64 << 20  # of a bitmap that is broadcast
FAR = 10  # bits of a bucket's number within a stretch, whose counts are summed first


@dataclass
class Bitmap:
    """``table`` (bucket, first, words, before) of a set of ids; ``n_bytes`` are its size, about."""

    table: DataFrame
    n_ids: int
    n_bytes: int

    def fits(self) -> bool:
        return self.n_bytes <= MOST_BYTES


def _bucket(column: Column) -> Column:
    return F.shiftright(column, 10)


def _word(column: Column) -> Column:
    return F.shiftright(column, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int")


def _bit(column: Column) -> Column:
    return column.bitwiseAND(F.lit(63)).cast("int")


def _power(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def id_bitmaps(ids: dict[str, DataFrame]) -> dict[str, Bitmap]:
    """A bitmap of each one-column table of ids; nulls and repeats count for nothing.

    All are built and written by one job. Words are put together before they are
    shuffled, and numbers of smaller ids are summed by stretches of buckets, so no task
    holds a whole set. The number of ids and bytes of each set reaches the driver.
    """
    parts = [d.select(F.lit(name).alias("name"), F.col(d.columns[0]).cast("long").alias("id")) for name, d in ids.items()]
    rows = reduce(DataFrame.union, parts).where("id is not null")
    at = F.struct(_bucket(F.col("id")).alias("bucket"), _word(F.col("id")).alias("word"))
    words = rows.select("name", at.alias("at"), _power(_bit(F.col("id"))).alias("bit"))
    words = words.groupBy("name", "at").agg(F.bit_or("bit").alias("bits"))
    each = F.sort_array(F.collect_list(F.struct(F.col("at.word").alias("word"), "bits")))  # at most WORDS
    buckets = words.groupBy("name", "at.bucket").agg(each.alias("each"))
    first = F.get("each", F.lit(0))["word"]
    span = F.sequence(first, F.element_at("each", -1)["word"])
    filled = F.transform(span, lambda w: F.coalesce(F.get(F.filter("each", lambda e: e["word"] == w), F.lit(0))["bits"], F.lit(0)))
    sized = buckets.select("name", "bucket", first.alias("first"), filled.alias("words"))
    n = F.aggregate("words", F.lit(0).cast("long"), lambda total, bits: total + F.bit_count(bits))
    sized = staged(sized.withColumns({"n": n, "far": F.shiftright("bucket", FAR)}), "bitmap-words")

    stretches = sized.groupBy("name", "far").agg(F.sum("n").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("name").orderBy("far")) - F.col("_n")
    stretches = stretches.select(F.col("name").alias("_name"), F.col("far").alias("_far"), ahead.alias("_ahead"))
    inside = F.sum("n").over(Window.partitionBy("name", "far").orderBy("bucket")) - F.col("n")
    placed = sized.withColumn("_inside", inside).join(stretches, (F.col("name") == F.col("_name")) & (F.col("far") == F.col("_far")))
    start = F.col("_ahead") + F.col("_inside")
    below = lambda k: F.aggregate(F.slice("words", F.lit(1), k), start, lambda total, bits: total + F.bit_count(bits))
    before = F.transform(F.sequence(F.lit(0), F.size("words") - 1), below)
    table = staged(placed.select("name", "bucket", "first", "words", before.alias("before")), "bitmaps")
    n_bytes = F.sum(F.size("words") * 16 + 64).alias("n_bytes")
    found = {r.name: r for r in sized.groupBy("name").agg(F.sum("n").alias("n"), n_bytes).collect()}
    sizes = {name: (found[name].n, found[name].n_bytes) if name in found else (0, 0) for name in ids}
    return {name: Bitmap(table.where(F.col("name") == name).drop("name"), *sizes[name]) for name in ids}


def _beside(df: DataFrame, bitmap: Bitmap, column: str, *parts: str, how: str = "inner") -> DataFrame:
    """Rows beside the bitmap's row of their id's bucket."""
    table = bitmap.table.select(F.col("bucket").alias("_bucket"), F.col("first").alias("_first"), *[F.col(p).alias(f"_{p}") for p in parts])
    table = F.broadcast(table) if bitmap.fits() else table
    return df.join(table, _bucket(F.col(column)) == F.col("_bucket"), how)


def _bits(column: str) -> Column:
    """The word of an id, 0 where it is left out."""
    return F.coalesce(F.get("_words", _word(F.col(column)) - F.col("_first")), F.lit(0))


def _has(column: str) -> Column:
    return F.call_function("getbit", _bits(column), _bit(F.col(column))) == 1


def keep_marked(df: DataFrame, bitmap: Bitmap, column: str) -> DataFrame:
    """Rows whose id is in the set; rows with a null id go."""
    return _beside(df, bitmap, column, "words").where(_has(column)).select(*df.columns)


def flag_marked(df: DataFrame, bitmap: Bitmap, column: str, name: str) -> DataFrame:
    """All rows, with ``name`` telling whether their id is in the set."""
    return _beside(df, bitmap, column, "words", how="left").select(*df.columns, F.coalesce(_has(column), F.lit(False)).alias(name))


def _number(column: str) -> Column:
    smaller = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), _bit(F.col(column))))
    below = F.bit_count(_bits(column).bitwiseAND(smaller))
    return (F.get("_before", _word(F.col(column)) - F.col("_first")) + below).cast("long")


def number_marked(df: DataFrame, bitmap: Bitmap, column: str, name: str | None = None) -> DataFrame:
    """Rows whose id is in the set, with its dense id in its place, or as ``name``."""
    name = name or column
    kept = [F.col(c) for c in df.columns if c not in (column, name)]
    return _beside(df, bitmap, column, "words", "before").where(_has(column)).select(*kept, _number(column).alias(name))


def number_or_null(df: DataFrame, bitmap: Bitmap, column: str, name: str) -> DataFrame:
    """All rows, with the dense id of their id as ``name``, null where it is not in the set."""
    rest = [c for c in df.columns if c != name]
    return _beside(df, bitmap, column, "words", "before", how="left").select(*rest, F.when(_has(column), _number(column)).alias(name))
