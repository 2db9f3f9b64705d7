"""Sharding by balanced label propagation.

Documents that share a hub (here: an equal text; in general any (id, hub) table)
are linked. From an even start, rounds of joins move linked documents towards the
shard that most of their hubs' members are in, as far as its quota has room or
others leave it, best gains first; a hub larger than a shard so fills one shard
after the other. A last
pass makes the sizes exact, moving unlinked documents where there are any: the law
is ``rows``, shard counts at most one apart, and documents are numbered from 0 in
each shard.

What reaches the driver is counted per pair of shards and gain class: no links, no groups.

Defined results: null texts have size 1 and are linked with one another (and
apart from empty texts); repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, stored, utf8

ROUNDS = 40  # at most; propagation ends by itself when nothing moves
STILL = 1000  # a round that moves less than one in so many of the linked nodes is the last
BLOCK_ROWS = 4096  # rows numbered by one window partition
RUN_BLOCKS = 4096  # blocks summed up by one window partition
TICKETS = 1 << 20


def _hashed(*columns: Column | str, seed: int) -> Column:
    """A non-negative pseudo-random long that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def _wishes(placed: DataFrame, links: DataFrame, open_shards: list[int], shards: int) -> DataFrame:
    """(node, shard, goal, class): where the hubs of a node pull it, if elsewhere.

    Only open shards are goals, and they win ties against shut ones. Members of a hub
    break ties alike, so that they do not swap places for ever. ``class`` is the gain's power of two.
    """
    at = [F.sum(F.when(F.col("shard") == s, 1).otherwise(0)).alias(f"n{s}") for s in range(shards)]
    hubs = cut(links.join(placed, "node").groupBy("hub").agg(*at))  # so that a hot hub's join can be split
    pulls = links.join(hubs, "hub").groupBy("node").agg(
        F.min("hub").alias("first"), *[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)]
    )
    ranks = [
        F.when(
            F.lit(s in open_shards) | (F.col("shard") == s),
            F.struct(
                F.col(f"n{s}").alias("pull"),
                F.lit(s in open_shards).alias("open"),
                _hashed("first", F.lit(s), seed=3).alias("tie"),
                F.lit(s).alias("goal"),
            ),
        )
        for s in range(shards)
    ]
    pull = F.array(*[f"n{s}" for s in range(shards)])
    wished = placed.join(pulls, "node").select(
        "node", "draw", "shard", F.greatest(*ranks).alias("best"), F.get(pull, F.col("shard")).alias("own")
    )
    gain = F.col("best.pull") - F.col("own")
    kind = F.when(gain > 0, F.floor(F.log2(gain)) + 1).otherwise(0).cast("int")
    return wished.where("best.goal != shard").select("node", "draw", "shard", F.col("best.goal").alias("goal"), kind.alias("class"))


def _quotas(wanted: list[tuple[int, int, int, int]], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(shard, goal, class, tickets): the share of each kind of wish that may move.

    ``wanted`` counts wishes per shard, goal and class of gain. A goal takes in as
    much as it has room and gives away itself; the least gains are turned down
    first, until that holds for all.
    """
    moves = {(a, b, kind): n for a, b, kind, n in wanted}
    while True:
        into, out = [0] * len(room), [0] * len(room)
        for (a, b, _), n in moves.items():
            into[b] += n
            out[a] += n
        over = {g: into[g] - room[g] - out[g] for g in range(len(room)) if into[g] > room[g] + out[g]}
        if not over:
            break
        for a, b, kind in sorted(moves, key=lambda m: m[2]):
            cut = min(moves[a, b, kind], over.get(b, 0))
            if cut:
                moves[a, b, kind] -= cut
                over[b] -= cut
    asked = {(a, b, kind): n for a, b, kind, n in wanted}
    return [(*m, n * TICKETS // asked[m]) for m, n in moves.items() if n]


def propagate(placed: DataFrame, links: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, draw, shard) of the linked nodes after at most ``rounds`` rounds.

    A node's ticket comes from its draw; of wishes that fit in part, the tickets
    below their share move. A goal that can take nothing in is no goal until it has
    room again. A round without wishes ends it.
    """
    spark = placed.sparkSession
    shut: set[int] = set()
    for turn in range(rounds):
        held = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
        room = [max(0, capacity - held.get(s, 0)) for s in range(shards)]
        shut = {s for s in shut if not room[s]}
        wishes = cut(_wishes(placed, links, [s for s in range(shards) if s not in shut], shards))
        counted = wishes.groupBy("shard", "goal", "class").count().collect()  # at most 64 classes a pair of shards
        wanted = [tuple(r) for r in counted]
        if not wanted:
            break
        quotas = _quotas(wanted, room)
        shut |= {w[1] for w in wanted} - {q[1] for q in quotas}
        if not quotas:
            continue
        table = F.broadcast(spark.createDataFrame(quotas, "shard int, goal int, class int, tickets long"))
        ticket = F.pmod(_hashed("draw", seed=11 + turn), F.lit(TICKETS))
        moves = wishes.join(table, ["shard", "goal", "class"]).where(ticket < F.col("tickets"))
        moves = cut(moves.select("node", F.col("goal").alias("moved")))
        placed = cut(
            placed.join(moves, "node", "left").select("node", "draw", F.coalesce("moved", "shard").alias("shard"))
        )
        if moves.count() * STILL < sum(held.values()):
            break
    return placed


def _numbered(rows: DataFrame, shards: int) -> tuple[DataFrame, list[int]]:
    """Add ``slot``, gapless from 0 in each shard in ``order``, and give the shards' counts.

    Rows fall into blocks by their order; a block that equal orders make large is
    cut again by the rows' draws. Counts of blocks, a few bytes per ``BLOCK_ROWS``
    rows, are summed up, and rows are ordered inside blocks only.
    """
    total = rows.count()
    blocks = max(1, total // shards // BLOCK_ROWS)
    block = F.floor(F.col("order") / (float(1 << 63) / blocks))
    rows = rows.withColumn("block", F.least(block, F.lit(blocks - 1)).cast("int"))
    sizes = cut(rows.groupBy("shard", "block").agg(F.count("*").alias("n")))
    cuts = F.when(F.col("n") > 4 * BLOCK_ROWS, F.ceil(F.col("n") / BLOCK_ROWS)).otherwise(F.lit(1))
    rows = rows.join(sizes, ["shard", "block"]).withColumn("part", F.pmod(_hashed("draw", seed=4), cuts).cast("int"))
    key = ["shard", "block", "part"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    # sums over runs of blocks, then over the blocks of a run
    run = F.floor(F.col("block") / RUN_BLOCKS)
    counts = cut(counts.withColumn("run", run))
    runs = counts.groupBy("shard", "run").agg(F.sum("n").alias("n_run"))
    earlier = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "run", F.coalesce(F.sum("n_run").over(earlier), F.lit(0)).alias("before"))
    before = Window.partitionBy("shard", "run").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(runs, ["shard", "run"])
    starts = cut(starts.select(*key, "n", (F.col("start") + F.col("before")).alias("start")))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("order", "draw", "node")) - 1
    slots = rows.drop("n").withColumn("inside", inside).join(starts.drop("n"), key)
    slots = slots.select("node", "shard", (F.col("inside") + F.col("start")).cast("long").alias("slot"))
    held = {r["shard"]: r["n"] for r in starts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return slots, [held.get(s, 0) for s in range(shards)]


def exact_rows(placed: DataFrame, shards: int) -> DataFrame:
    """(node, shard, slot) with counts at most one apart.

    Documents beyond a shard's quota, the last in its order, fill the free slots
    of the others one after the other.
    """
    spark = placed.sparkSession
    numbered, held = _numbered(placed, shards)
    total = sum(held)
    by_need = sorted(range(shards), key=lambda s: (-held[s], s))
    quota = [total // shards] * shards
    for s in by_need[: total % shards]:
        quota[s] += 1
    over = [max(0, h - q) for h, q in zip(held, quota, strict=True)]
    free = [max(0, q - h) for h, q in zip(held, quota, strict=True)]
    starts_over = [0, *accumulate(over)]
    starts_free = [0, *accumulate(free)]
    plan = [(s, quota[s], starts_over[s]) for s in range(shards)]
    homes = [(s, held[s], starts_free[s], starts_free[s + 1]) for s in range(shards) if free[s]]
    rows = numbered.join(F.broadcast(spark.createDataFrame(plan, "shard int, quota long, over long")), "shard")
    stay = F.col("slot") < F.col("quota")
    place = F.col("over") + F.col("slot") - F.col("quota")
    new_shard, new_slot = F.col("shard"), F.col("slot")
    for s, had, first, last in homes:  # one branch per shard with free slots
        here = ~stay & (place >= first) & (place < last)
        new_shard = F.when(here, F.lit(s)).otherwise(new_shard)
        new_slot = F.when(here, place - first + had).otherwise(new_slot)
    return rows.select("node", new_shard.cast("int").alias("shard"), new_slot.cast("long").alias("slot"))


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard, slot) of every node under the law of equal row counts.

    ``nodes`` (node, draw): ``draw``, a non-negative pseudo-random long, decides
    starts and ties. ``links`` (node, hub): nodes of one hub are linked. Only linked
    nodes take part in the rounds; the others then fill the shards up.
    """
    start = F.pmod(_hashed("draw", seed=1), F.lit(shards)).cast("int")
    placed = nodes.select("node", "draw", start.alias("shard"))
    linked = cut(placed.join(links.select("node").distinct(), "node"))
    moved = propagate(linked, links, shards, nodes.count() // shards, rounds)
    moved = moved.select("node", F.col("shard").alias("moved"))
    # a shard's order: linked nodes first, hub by hub. What overflows is unlinked as far as
    # that goes, and otherwise whole hubs
    first = links.groupBy("node").agg(F.min(_hashed("hub", seed=2)).alias("first"))
    linked_order = F.shiftright("first", 1)
    order = F.coalesce(linked_order, F.shiftright("draw", 1) + F.lit(1 << 62))
    rows = placed.join(moved, "node", "left").join(first, "node", "left")
    rows = rows.select("node", "draw", order.alias("order"), F.coalesce("moved", "shard").alias("shard"))
    return exact_rows(cut(rows), shards)


def shard_documents(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; equal texts are linked."""
    rows = pick(docs, id_col, text_col).toDF("s_id", "s_text")
    hub = F.coalesce(F.sha2(F.col("s_text"), 256), F.lit("null"))
    facts = stored(
        rows.select(
            F.monotonically_increasing_id().alias("node"),
            "s_id",
            (F.coalesce(F.octet_length("s_text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(utf8(F.col("s_text"))).alias("text_crc32"),
            hub.alias("hub"),
            _hashed("s_id", hub, seed=2).alias("draw"),
        ),
        "shards",
    )
    # written first, so that the join by a hot hub can be split
    shared = stored(facts.groupBy("hub").count().where("count > 1").select("hub"), "hubs")
    links = cut(facts.select("node", "hub").join(shared, "hub").select("node", "hub"))
    found = balanced_shards(facts.select("node", "draw"), links, shards)
    return facts.join(found, "node").select(
        F.col("s_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
