"""Schemas of the raw tables and the rule that types their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of each kind of raw table, in file order, and whether they hold whole numbers.
FIELDS = {
    "user": {"user_id": int, "country": str, "age": int, "gender": str, "playcount": int, "registered_unixtime": int},
    "album": {"album_id": int, "album_name": str, "artist_id": int},
    "artist": {"artist_id": int, "artist_name": str},
    "track": {"track_id": int, "track_name": str, "artist_id": int},
    "le": {"user_id": int, "artist_id": int, "album_id": int, "track_id": int, "timestamp": int},
    "genre": {"genre_id": int, "genre_name": str},
}
COLUMNS = {kind: tuple(fields) for kind, fields in FIELDS.items()}
INTEGERS = frozenset(name for fields in FIELDS.values() for name, kind in fields.items() if kind is int)
# Texts read as missing.
MISSING = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "#N/A", "<NA>")


def columns(kind: str) -> tuple[str, ...]:
    """Columns of a kind of table; an unknown kind is an error."""
    if kind not in COLUMNS:
        raise ValueError(f"unknown kind of table: {kind!r}; known are {', '.join(sorted(COLUMNS))}")
    return COLUMNS[kind]


def raw_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns(kind)])


def typed_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType() if c in INTEGERS else T.StringType()) for c in columns(kind)])


def as_integer(column: Column) -> Column:
    """The value of an integer literal, blanks around it allowed; null for any other text."""
    text = F.trim(column.cast("string"))
    value = text.try_cast("bigint")
    # a number's own form needs no pattern; the cast alone also allows other blanks around it
    return F.when(value.cast("string") == text, value).when(text.rlike("^[+-]?[0-9]+$"), value)


def typed(raw: DataFrame) -> DataFrame:
    """Columns typed by name: integers by ``as_integer``, others as text.

    Integers are unpacked from one struct a row: filters and joins on plain expressions of
    texts would be repeated below the joins that make the texts, each parsing them again.
    """
    integers = [as_integer(F.col(c)).alias(c) for c in raw.columns if c in INTEGERS]
    texts = [F.col(c).cast("string").alias(c) for c in raw.columns if c not in INTEGERS]
    if not integers:
        return raw.select(*texts)
    return raw.select(*texts, F.inline(F.array(F.struct(*integers)))).select(*raw.columns)


def _whole(df: DataFrame) -> Column:
    checks = [F.col(c).isNotNull() for c in df.columns if c in INTEGERS]
    found = F.lit(True)
    for check in checks:
        found = found & check
    return found


def valid(df: DataFrame) -> DataFrame:
    """Rows of a typed table whose integer columns all have a value."""
    return df.where(_whole(df))


def invalid(raw: DataFrame) -> DataFrame:
    """Rows of a raw table that ``valid(typed(raw))`` drops, as they came."""
    bad = F.lit(False)
    for c in raw.columns:
        if c in INTEGERS:
            bad = bad | as_integer(F.col(c)).isNull()
    return raw.where(bad)


def timestamp_seconds(column: Column) -> Column:
    """Unix seconds of a timestamp without zone, taken as UTC."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz"))
