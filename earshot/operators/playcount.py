"""Playcounts, relative playcounts and popularity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import Bitmap, number_marked, number_or_null
from .ids import positions, remap


def dense_events(events: DataFrame, users: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """(user, item, ts) in dense ids; events of unmapped users or items are dropped."""
    rows = events.select(F.col("user_id").alias("user"), F.col(f"{item}_id").alias("item"), F.col("timestamp").alias("ts"))
    return remap(remap(rows, users, "user"), items, "item").select("user", "item", "ts")


def number_events(events: DataFrame, users: Bitmap, items: Bitmap, item: str) -> DataFrame:
    """(user, item, ts) as ``dense_events`` gives it, numbered by bitmaps of the known ids: no shuffle of events."""
    rows = events.select(F.col("user_id").alias("user"), F.col(f"{item}_id").alias("item"), F.col("timestamp").alias("ts"))
    return number_marked(number_marked(rows, users, "user"), items, "item").select("user", "item", "ts")


def number_all(events: DataFrame, users: Bitmap, items: Mapping[str, Bitmap]) -> DataFrame:
    """(user, ts, and a column an item type) in dense ids, null where an item is unknown: one pass over events."""
    rows = number_marked(events.select(F.col("user_id").alias("user"), *[f"{k}_id" for k in items], F.col("timestamp").alias("ts")), users, "user")
    for k, bitmap in items.items():
        rows = number_or_null(rows, bitmap, f"{k}_id", k)
    return rows.select("user", "ts", *items)


def of_item(numbered: DataFrame, item: str) -> DataFrame:
    """(user, item, ts) of ``number_all``'s rows, as ``dense_events`` gives it."""
    return numbered.where(F.col(item).isNotNull()).select("user", F.col(item).alias("item"), "ts")


def playcount(dense: DataFrame) -> DataFrame:
    return dense.groupBy("user", "item").agg(F.count("*").alias("plays"))


def user_plays(dense: DataFrame) -> DataFrame:
    return dense.groupBy("user").agg(F.count("*").alias("plays"))


def relative_playcount(dense: DataFrame) -> DataFrame:
    """(user, item, share): a pair's plays over all plays of the user."""
    total = F.sum("plays").over(Window.partitionBy("user"))
    return playcount(dense).select("user", "item", (F.col("plays") / total).alias("share"))


def popularity(artists: DataFrame, events: DataFrame) -> DataFrame:
    """(artist_id, plays) of every artist, those without events included."""
    plays = events.groupBy("artist_id").agg(F.count("*").alias("_plays"))
    ids = artists.select("artist_id").distinct()
    return ids.join(plays, "artist_id", "left").select("artist_id", F.coalesce("_plays", F.lit(0)).alias("plays"))


def popularity_cutoff(popular: DataFrame, sigmas: float = 2.5) -> DataFrame:
    """One row: mean plus so many population standard deviations, rounded half to even."""
    return popular.agg(F.rint(F.avg("plays") + sigmas * F.stddev_pop("plays")).alias("cutoff"))


def popular_artists(popular: DataFrame, sigmas: float = 2.5) -> DataFrame:
    """Artists with more plays than the cutoff."""
    cutoff = F.broadcast(popularity_cutoff(popular, sigmas))  # one row
    return popular.join(cutoff, F.col("plays") > F.col("cutoff")).select("artist_id", "plays")


def chronological(dense: DataFrame, buckets: int | None = None) -> DataFrame:
    """Events with their place in order of time, user and item as ``edge_id``."""
    return positions(dense, ["ts", "user", "item"], "edge_id", buckets)
