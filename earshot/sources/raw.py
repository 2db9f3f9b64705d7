"""Readers of raw and cleaned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schemas import INTEGERS, MISSING, as_integer, columns, raw_schema, typed, typed_schema, valid
from .staging import staged

BROKEN = "_broken_row"


def _parsed(spark: SparkSession, path: str, kind: str, header: bool | None) -> tuple[DataFrame, Column]:
    """All rows of a raw file as text, broken ones whole in ``BROKEN``; and whether a row is whole."""
    schema = T.StructType([*raw_schema(kind).fields, T.StructField(BROKEN, T.StringType())])
    # a row is broken by its fields, whichever columns are asked for
    rows = spark.read.options(columnPruning=False).csv(
        path,
        schema=schema,
        sep="\t",
        quote='"',
        escape='"',
        header=kind == "user" if header is None else header,
        enforceSchema=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=BROKEN,
    )
    # the parser wants another column beside the broken row's; every text has a length
    return rows, F.col(BROKEN).isNull() & (F.length(F.coalesce(schema[0].name, F.lit(""))) >= 0)


def read_raw(spark: SparkSession, path: str, kind: str, header: bool | None = None, missing: Sequence[str] = MISSING) -> DataFrame:
    """All rows of a tab-separated raw table as text; rows with a wrong number of fields are dropped.

    Only user tables come with a header, unless ``header`` says otherwise.
    """
    rows, whole = _parsed(spark, path, kind, header)
    return blank_missing(rows.where(whole).drop(BROKEN), missing)


def judged_raw(spark: SparkSession, path: str, kind: str, header: bool | None = None, missing: Sequence[str] = MISSING) -> DataFrame:
    """The typed columns of every row and ``_reason``, ``_file``, ``_row``.

    The reason is null for rows that ``scan_raw`` keeps, ``fields`` where their number is
    wrong, else ``type`` of an integer column without a whole number; the others have
    the file and, put together again, the row.
    """
    rows, whole = _parsed(spark, path, kind, header)
    names = columns(kind)
    broken = F.when(~whole, "fields").alias("_reason")
    text = F.coalesce(BROKEN, F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in names])).alias("_row")
    rows = rows.select(*names, broken, text, F.col("_metadata.file_path").alias("_file"))
    blank = {c: F.when(~F.col(c).isin(*missing), F.col(c)) for c in names}
    cast = {c: as_integer(blank[c]) if c in INTEGERS else blank[c] for c in names}
    wrong = [F.when(cast[c].isNull(), f"type of {c}") for c in names if c in INTEGERS]
    reason = F.coalesce("_reason", *wrong, F.lit(None).cast("string"))
    told = rows.select(*[cast[c].alias(c) for c in names], reason.alias("_reason"), "_file", "_row")
    kept = F.col("_reason").isNull()
    return told.select(*names, "_reason", F.when(~kept, F.col("_file")).alias("_file"), F.when(~kept, F.col("_row")).alias("_row"))


def split_raw(spark: SparkSession, path: str, kind: str, header: bool | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(kept, rejects, counts) of a raw table that is parsed once and staged.

    ``rejects`` has (kind, reason, file, row); counts of lines, kept and rejected rows are
    observed while staging.
    """
    seen = Observation()
    kept = F.count(F.when(F.col("_reason").isNull(), 1))
    judged = judged_raw(spark, path, kind, header).observe(seen, F.count(F.lit(1)).alias("lines"), kept.alias("kept"))
    rows = staged(judged, f"raw-{kind}")
    counts = dict(seen.get)
    counts["rejected"] = counts["lines"] - counts["kept"]
    rejects = rows.where("_reason is not null").select(F.lit(kind).alias("kind"), F.col("_reason").alias("reason"), F.col("_file").alias("file"), F.col("_row").alias("row"))
    return rows.where("_reason is null").select(*columns(kind)), rejects, counts


def blank_missing(raw: DataFrame, missing: Sequence[str] = MISSING) -> DataFrame:
    """Texts that stand for a missing value become null."""
    return raw.select(*[F.when(~F.col(c).isin(*missing), F.col(c)).alias(c) for c in raw.columns])


def scan_raw(spark: SparkSession, path: str, kind: str, header: bool | None = None) -> DataFrame:
    """A raw table typed, without the rows that cannot be."""
    return valid(typed(read_raw(spark, path, kind, header)))


def scan_clean(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A cleaned tab-separated table with header; any value of a wrong type is an error when read."""
    return spark.read.csv(
        path, schema=typed_schema(kind), sep="\t", quote='"', escape='"', header=True, enforceSchema=True, mode="FAILFAST"
    )


def genre_lines(lines: DataFrame) -> DataFrame:
    """(artist_name, genre_id) of ragged lines ``value``: a name, then any number of genre ids."""
    fields = F.split("value", "\t")
    pairs = lines.select(
        F.trim(F.get(fields, F.lit(0))).alias("artist_name"),
        F.explode(F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))).alias("field"),
    )
    return pairs.select("artist_name", as_integer(F.col("field")).alias("genre_id")).where("genre_id is not null")


def read_genre_lines(spark: SparkSession, path: str) -> DataFrame:
    return genre_lines(spark.read.text(path))


def genre_dictionary(genres: DataFrame, sentinel: int | None = None, name: str = "na") -> DataFrame:
    """(genre_id, genre_name) with a last row for artists without genre.

    The sentinel's id is a parameter; by default it is the number of genres.
    """
    rows = genres.select(F.col("genre_id").cast("long").alias("genre_id"), "genre_name")
    if sentinel is None:
        last = rows.agg(F.count("*").alias("genre_id"), F.lit(name).alias("genre_name"))
    else:
        last = rows.sparkSession.range(1).select(F.lit(sentinel).cast("long").alias("genre_id"), F.lit(name).alias("genre_name"))
    return rows.unionByName(last)


def read_genre_dictionary(spark: SparkSession, path: str, sentinel: int = 20) -> DataFrame:
    """A file of one genre name per line, small enough to number by line position."""
    lines = spark.read.text(path, wholetext=True)
    named = lines.select(F.posexplode(F.split(F.regexp_replace("value", "[\r\n]+$", ""), "\r?\n")).alias("genre_id", "genre_name"))
    return genre_dictionary(named, sentinel)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))
