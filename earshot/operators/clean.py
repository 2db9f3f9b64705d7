"""Cleaning: unnamed and dangling ids, closed tables, user attributes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import id_bitmaps, keep_marked

# Bands of eligible users and the values the quotas know.
AGE_BAND = (15.7, 35.1)
PLAYCOUNT_BAND = (7083, 24841)


def is_unnamed(name: str) -> Column:
    """Missing, the text 'nan', or the column's own name: such an entity has no name."""
    return F.col(name).isNull() | F.col(name).isin("nan", name)


def unnamed_ids(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return df.where(is_unnamed(name_col)).select(id_col).distinct()


def keep_ids(df: DataFrame, good: DataFrame, column: str) -> DataFrame:
    """Rows whose id is among the good ones; ``good`` has one column."""
    ids = good.select(F.col(good.columns[0]).alias("_good"))
    return df.join(ids, F.col(column) == F.col("_good"), "left_semi")


def drop_ids(df: DataFrame, bad: DataFrame, column: str) -> DataFrame:
    """Rows whose id is not among the bad ones: every row of a bad id goes."""
    ids = bad.select(F.col(bad.columns[0]).alias("_bad"))
    return df.join(ids, F.col(column) == F.col("_bad"), "left_anti")


def named(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Rows of ids that have no unnamed row."""
    return drop_ids(df, unnamed_ids(df, id_col, name_col), id_col)


def filter_events(events: DataFrame, good: dict[str, DataFrame]) -> DataFrame:
    """Events whose every listed key is good, each judged by itself.

    The good ids become bitmaps, which go to the events: these are not shuffled, but by
    a key whose bitmap is too large to be broadcast.
    """
    marked = id_bitmaps(good)
    order = sorted(good, key=lambda key: (not marked[key].fits(), marked[key].n_bytes))
    return reduce(lambda df, key: keep_marked(df, marked[key], key), order, events)


def active_users(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users that still have an event."""
    return keep_ids(users, events.select("user_id"), "user_id")


def fill_attributes(users: DataFrame) -> DataFrame:
    """Missing country and gender become 'NA'."""
    return users.withColumns({c: F.coalesce(c, F.lit("NA")) for c in ("country", "gender")})


def dangling_ids(keys: DataFrame, lists: Sequence[DataFrame]) -> DataFrame:
    """Ids that stand in any of the lists and not among the keys; one column each."""
    name = keys.columns[0]
    seen = reduce(DataFrame.union, (d.toDF(name) for d in lists)).distinct()
    return seen.join(keys.distinct(), name, "left_anti")


def distinct_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(id_column, id): the distinct ids of each column."""
    parts = [df.select(F.lit(c).alias("id_column"), F.col(c).alias("id")).distinct() for c in columns]
    return reduce(DataFrame.union, parts)


def good_artist_ids(artists: DataFrame, albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """Artists with a row of their own, an album and a track."""
    ids = artists.select("artist_id").distinct()
    return keep_ids(keep_ids(ids, albums.select("artist_id"), "artist_id"), tracks.select("artist_id"), "artist_id")


def closure_check(artists: DataFrame, albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row: artist rows, distinct artists of albums and of tracks, and whether all agree."""
    parts = [
        artists.select(F.lit("rows").alias("kind"), F.col("artist_id").alias("id")),
        albums.select(F.lit("albums").alias("kind"), F.col("artist_id").alias("id")).distinct(),
        tracks.select(F.lit("tracks").alias("kind"), F.col("artist_id").alias("id")).distinct(),
    ]
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("rows", "albums", "tracks")]
    found = reduce(DataFrame.union, parts).agg(*counts)
    same = (F.col("n_rows") == F.col("n_albums")) & (F.col("n_rows") == F.col("n_tracks"))
    return found.withColumn("closed", same)


def require_closure(check: DataFrame) -> None:
    row = check.first()
    require_agreement(row.n_rows, row.n_albums, row.n_tracks)


def require_agreement(n_rows: int, n_albums: int, n_tracks: int) -> None:
    """Artist rows, artists of albums and artists of tracks must be as many; else this is an error."""
    if not n_rows == n_albums == n_tracks:
        raise ValueError(f"artists differ between tables: {n_rows} artist rows, {n_albums} artists of albums, {n_tracks} of tracks")


def user_profile(users: DataFrame, countries: Sequence[str], genders: Sequence[str]) -> DataFrame:
    """Attributes as the quotas know them: other countries 'NA', other genders 'n', ages below 0 unknown."""
    age = F.when(F.col("age") >= 0, F.col("age"))
    return users.select(
        "user_id",
        F.when(F.col("country").isin(*countries), F.col("country")).otherwise("NA").alias("country"),
        age.alias("age"),
        F.when(age.isNull(), "NA").otherwise("good").alias("age_key"),
        F.when(F.col("gender").isin(*genders), F.col("gender")).otherwise("n").alias("gender"),
        "playcount",
    )


def eligible(profile: DataFrame) -> DataFrame:
    """Users inside the bands, borders excluded; an unknown age passes."""
    age = F.col("age").isNull() | ((F.col("age") > AGE_BAND[0]) & (F.col("age") < AGE_BAND[1]))
    plays = (F.col("playcount") > PLAYCOUNT_BAND[0]) & (F.col("playcount") < PLAYCOUNT_BAND[1])
    return profile.where(age & plays)
