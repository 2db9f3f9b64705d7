"""Demographic quotas and seeded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares in thousandths of a percent.
COUNTRIES = {
    "US": 18581,
    "RU": 9103,
    "DE": 8295,
    "UK": 8295,
    "PL": 7987,
    "BR": 7041,
    "FI": 2553,
    "NL": 2491,
    "ES": 2252,
    "SE": 2230,
    "UA": 2071,
    "CA": 1951,
    "FR": 1912,
    "NA": 54131,
}
GENDERS = {"m": 33218, "f": 13130, "n": 53649}
AGES = {"NA": 61690, "good": 38310}
MARGINS = {"country": COUNTRIES, "gender": GENDERS, "age_key": AGES}

RANGE_DIGITS = 3  # hexadecimal digits of a key that name its range


def apportion(shares: dict[str, int], n: int) -> dict[str, int]:
    """Whole quotas that sum to n.

    Floors of the shares of n, then single units, a round over all values at a
    time: given in order of larger remainder, or taken in order of smaller
    remainder from what is above 0.
    """
    quota = {k: v * n // 100_000 for k, v in shares.items()}
    rest = {k: v * n % 100_000 for k, v in shares.items()}
    missing = n - sum(quota.values())
    while missing > 0:
        for k in sorted(quota, key=lambda k: (-rest[k], k))[:missing]:
            quota[k] += 1
            missing -= 1
    while missing < 0:
        able = [k for k in sorted(quota, key=lambda k: (rest[k], k)) if quota[k] > 0]
        for k in able[:-missing]:
            quota[k] -= 1
            missing += 1
    return quota


def quotas(n: int) -> dict[str, dict[str, int]]:
    return {margin: apportion(shares, n) for margin, shares in MARGINS.items()}


def quota_table(eligible: DataFrame, n: int) -> DataFrame:
    """(margin, value, quota, available): each quota beside the eligible users with that value."""
    rows = [(m, v, q) for m, values in quotas(n).items() for v, q in values.items()]
    table = eligible.sparkSession.createDataFrame(rows, "margin string, value string, quota long")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS]))
    seen = eligible.select(pairs.alias("p")).groupBy("p.margin", "p.value").agg(F.count("*").alias("_n"))
    return table.join(seen, ["margin", "value"], "left").select(
        "margin", "value", "quota", F.coalesce("_n", F.lit(0)).alias("available")
    )


def seeded_key(id_col: str, seed: int) -> Column:
    """A key whose order is a random order of the ids, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("order_key", seeded_key(id_col, seed))


def first_within(keyed: DataFrame, group: str, limit: str, place: str) -> DataFrame:
    """The first ``limit`` rows of each group in order of ``order_key``, and their 0-based place.

    Rows are counted by ranges of their keys, which are even; ranges that begin behind
    a group's limit are left out, and rows are ranked within a range only. No group
    is gathered and nothing is sorted as a whole. ``limit`` is one number a group.
    """
    ranged = keyed.withColumn("_range", F.substring("order_key", 1, RANGE_DIGITS))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.first(limit).alias("_most"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")
    begun = counts.withColumn("_before", before).where(F.col("_before") < F.col("_most"))
    begun = begun.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), "_before")
    inside = ranged.join(begun, (F.col(group) == F.col("_group")) & (F.col("_range") == F.col("_at")))
    nth = F.row_number().over(Window.partitionBy("_group", "_at").orderBy("order_key")) - 1
    placed = inside.withColumn(place, F.col("_before") + nth).where(F.col(place) < F.col(limit))
    return placed.drop("_range", "_group", "_at", "_before")


def stratified_sample(users: DataFrame, column: str, quota: dict[str, int], seed: int) -> DataFrame:
    """The first so many users of each value in seeded order, with their place."""
    table = users.sparkSession.createDataFrame(list(quota.items()), f"{column} string, quota long")
    keyed = seeded_order(users.select("user_id", column), "user_id", seed).join(F.broadcast(table), column)  # one row per value
    ranked = first_within(keyed, column, "quota", "rank")
    return ranked.select("user_id", column, (F.col("rank") + 1).cast("long").alias("place"))


@dataclass
class _Open:
    """What the rounds of a joint sample keep: open quotas, and how far it has come."""

    left: dict[str, dict[str, int]]
    cut: str = ""
    accepted: list[Column] = field(default_factory=list)

    def condition(self) -> Column:
        found = F.col("order_key") > self.cut
        for margin, values in self.left.items():
            found = found & F.col(margin).isin(*[v for v, q in values.items() if q > 0])
        return found

    def closed(self) -> bool:
        return any(not any(q > 0 for q in values.values()) for values in self.left.values())


def _ends(now: DataFrame, left: dict[str, dict[str, int]]) -> list[str]:
    """The keys at which the open quotas close, each that of a value's user numbered as its quota.

    Users are counted by ranges of their keys, which are even; only the range in
    which a quota closes is ranked.
    """
    rows = [(m, v, q) for m, values in left.items() for v, q in values.items() if q > 0]
    table = now.sparkSession.createDataFrame(rows, "margin string, value string, quota long")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS]))
    each = now.select("order_key", F.substring("order_key", 1, RANGE_DIGITS).alias("range"), pairs.alias("p"))
    each = each.select("order_key", "range", "p.margin", "p.value")
    counts = each.groupBy("margin", "value", "range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("margin", "value").orderBy("range")) - F.col("_n")
    counts = counts.withColumn("_before", before).join(F.broadcast(table), ["margin", "value"])  # one row per value
    closing = counts.where((F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("_n")))
    closing = closing.select("margin", "value", "range", (F.col("quota") - F.col("_before")).alias("_last"))
    inside = each.join(F.broadcast(closing), ["margin", "value", "range"])  # one row per value
    nth = F.row_number().over(Window.partitionBy("margin", "value").orderBy("order_key"))
    return [r.order_key for r in inside.withColumn("_nth", nth).where("_nth = _last").select("order_key").collect()]


def quota_sample(eligible: DataFrame, n: int, seed: int) -> DataFrame:
    """Users taken one by one in seeded order while all their quotas are open.

    Each round finds where the first quota closes and takes all open users up to
    there, so there are at most as many rounds as quotas. A cell of the three
    margins gives a prefix of its order only, so the rounds work on the first few
    users of each cell, at most (cells x n) rows. At most 84 counts and 19 keys
    reach the driver per round.
    """
    state = _Open(quotas(n))
    least = F.least(
        *[
            F.coalesce(*[F.when(F.col(m) == v, F.lit(q)) for v, q in values.items()], F.lit(0))
            for m, values in state.left.items()
        ]
    )
    margins = list(MARGINS)
    keyed = seeded_order(eligible.select("user_id", *margins), "user_id", seed).withColumn("_cell", F.concat_ws("|", *margins))
    cells = first_within(keyed.withColumn("_least", least), "_cell", "_least", "_place")
    cells = cells.select("user_id", "order_key", *margins).persist()
    try:
        while not state.closed():
            now = cells.where(state.condition())
            ends = _ends(now, state.left)
            taken = now.where(F.col("order_key") <= min(ends)) if ends else now
            bound = state.condition() & (F.col("order_key") <= min(ends)) if ends else state.condition()
            counts = taken.groupBy(*margins).count().collect()
            state.accepted.append(bound)
            for row in counts:
                for margin in margins:
                    state.left[margin][row[margin]] -= row["count"]
            if not ends:
                break
            state.cut = min(ends)
    finally:
        cells.unpersist()
    found = F.lit(False)
    for condition in state.accepted:
        found = found | condition
    return cells.where(found).select("user_id", *margins)
