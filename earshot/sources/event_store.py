"""Events stored by user: what is joined or grouped by user needs no shuffle.

Events lie in buckets of their user, sorted by user and time. A user with more events
than a bucket should hold lies in a plain table beside them, so that no bucket is
much larger than others. Both hold whole users, so whatever works user by user is
done on each part and put together (``by_user``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import hot_keys, read_bucketed, write_bucketed
from .staging import staged_once


@dataclass
class EventStore:
    """``cold`` events in buckets, and those of ``hot`` users, None if there are none."""

    cold: DataFrame
    hot: DataFrame | None
    user: str

    def by_user(self, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` over all events; it must not mix users."""
        return work(self.cold) if self.hot is None else work(self.cold).unionByName(work(self.hot))

    def events(self) -> DataFrame:
        return self.by_user(lambda df: df)


def write_events(events: DataFrame, path: str, user: str = "user_id", time: str = "timestamp", buckets: int | None = None) -> EventStore:
    """Store events at the path, over what was there; the list of hot users comes last and marks it complete."""
    spark = events.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = staged_once(events, "events")  # read for the counts and again
    hot = hot_keys(events, user, 1 / buckets) if buckets > 1 else []
    is_hot = F.col(user).isin(*hot) if hot else F.lit(False)
    write_bucketed(events.where(~is_hot | F.col(user).isNull()), f"{path}/cold", user, [user, time], buckets)
    if hot:
        events.where(is_hot).write.mode("overwrite").parquet(f"{path}/hot")
    table = spark.createDataFrame([(user, h) for h in hot] or [(user, None)], f"user string, hot {events.schema[user].dataType.simpleString()}")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/hot-users")
    return read_events(spark, path)


def read_events(spark: SparkSession, path: str) -> EventStore:
    users = spark.read.parquet(f"{path}/hot-users")
    first = users.orderBy(F.desc_nulls_last("hot")).first()
    hot = None if first.hot is None else spark.read.parquet(f"{path}/hot")
    return EventStore(read_bucketed(spark, f"{path}/cold"), hot, first.user)
