"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word target: the weights share out a multiple of all words,
no source above a multiple of its own. A source first gives complete epochs, then
a fractional selection: every document draws an exponential key scaled by its
quality weight, documents are taken in key order and the prefix sum of their
words is cut at the rest of the target. The weight is the posterior probability of
being good under the voting rules of ``quality``, fitted on all rows, and at least
``LEAST_WEIGHT``, so that poor documents come last but may come. As a count of words (``mix_sources``) the
document on the cut gives part of its words, so each source meets its target to
the word. As a corpus of whole documents it is taken or left, whichever ends nearer
the target; no text is changed.

The order within a source is never sorted in one task: keys fall in buckets, sums
per bucket find the one bucket that holds the cut, and its rows fall in buckets
again, until about ``BUCKET_ROWS`` rows are left, which are ordered. A pass so sums
up at most ``FAN`` buckets a source, whatever the source's size.

Defined results: a null text has no words and is never taken; a null source is a
source of its own, last in order; repeated rows draw the same key, and
those on a cut share what is left of the target equally, rounded down; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, pick, stored
from .quality import RULES, VoteModel, fit_rules, text_statistics, verdict

LEAST_WEIGHT = 0.1
BUCKET_ROWS = 1024
FAN = 1024  # buckets of a bucket
FEW_SOURCES = 20_000  # whose plan is broadcast: some 2 MB


def fill_targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Share ``share`` of all sizes by weight; what exceeds ``most`` sizes of a source is reshared."""
    target = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / whole
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def count_words(column: Column | str) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def quality_weight(model: VoteModel, stats: str = "m_stats") -> Column:
    """A weight in [LEAST_WEIGHT, 1] that grows with the posterior quality probability."""
    return LEAST_WEIGHT + (1 - LEAST_WEIGHT) * verdict(model, RULES, stats)[2]


def _drawn(rows: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """``rows`` with the statistics of their texts and 53 bits drawn by id and text."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text_col), 11)
    return rows.withColumn("m_stats", text_statistics(text_col)).withColumn("m_draw", draw)


def _keyed(drawn: DataFrame, model: VoteModel) -> DataFrame:
    """``m_size``, the words, and ``m_key``, the key scaled by quality, beside what was drawn."""
    key = -F.log((F.col("m_draw") + 0.5) / float(1 << 53)) / quality_weight(model)
    return drawn.withColumn("m_size", F.col("m_stats.n_words")).withColumn("m_key", key)


def _with_key(rows: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    drawn = _drawn(rows, id_col, text_col, seed)
    return _keyed(drawn, fit_rules(drawn, RULES, "m_stats"))


def _beside(rows: DataFrame, plan: list[tuple], schema: str) -> DataFrame:
    """Each row beside the plan of its source, which is broadcast if its sources are few, and joined otherwise."""
    table = rows.sparkSession.createDataFrame(plan, f"p_source string, {schema}")
    table = F.broadcast(table) if len(plan) <= FEW_SOURCES else table
    return rows.join(table, F.col("m_source").eqNullSafe(F.col("p_source"))).drop("p_source")


def plan_mix(keyed: DataFrame, weights: Sequence[float], share: float, most: float) -> list[tuple]:
    """(source, source_size, target, epochs, cut_key, cut_part, cut_rows, cut_all) of each source.

    ``keyed`` has m_source, m_size and m_key. Rows with a key below ``cut_key``
    are taken whole once more, those on it give ``cut_part`` words each or, of
    whole documents, ``cut_rows`` of these ``cut_all`` rows are taken.
    """
    totals = keyed.groupBy("m_source").agg(
        F.sum("m_size").alias("size"), F.count("*").alias("rows"), F.avg("m_key").alias("mean")
    )
    # a mix is as large as its list of sources: one row a source reaches the driver
    found = sorted(totals.collect(), key=lambda r: (r.m_source is None, r.m_source or ""))
    if not found:
        return []
    sizes = [r["size"] for r in found]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    epochs = [int(t // s) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    rest = [math.floor(t) - e * s for t, e, s in zip(targets, epochs, sizes, strict=True)]

    def crossing(sums: DataFrame, by: str) -> DataFrame:
        """The row of each source where the running sum of words passes its rest."""
        so_far = F.sum("words").over(Window.partitionBy("m_source").orderBy(by))
        sums = sums.withColumn("start", so_far - F.col("words"))
        return sums.where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words")))

    # keys are nearly exponential: their distribution function spreads them evenly over [0, 1)
    spread = 1 - F.exp(-F.col("m_key") / F.col("mean"))
    inside = keyed.select("m_source", "m_size", "m_key")
    parts = [(r.m_source, r["mean"], 0.0, 1.0, x, r["rows"]) for r, x in zip(found, rest, strict=True)]
    while parts:
        placed = _beside(inside, [p[:5] for p in parts], "mean double, low double, width double, rest long")
        place = F.floor((spread - F.col("low")) / F.col("width") * FAN)
        placed = placed.withColumn("bucket", F.greatest(F.lit(0), F.least(place, F.lit(FAN - 1))))
        if max(p[5] for p in parts) <= BUCKET_ROWS:
            break
        sums = placed.groupBy("m_source", "bucket", "mean", "low", "width", "rest").agg(F.sum("m_size").alias("words"), F.count("*").alias("n"))
        cuts = crossing(sums, "bucket").collect()
        at = [(r.m_source, r.bucket) for r in cuts]
        parts = [(r.m_source, r["mean"], r.low + r.bucket * r.width / FAN, r.width / FAN, r.rest - r.start, r.n) for r in cuts]
        if not at:
            break
        chosen = placed.sparkSession.createDataFrame(at, "k_source string, k_bucket long")
        chosen = F.broadcast(chosen) if len(at) <= FEW_SOURCES else chosen
        same = F.col("m_source").eqNullSafe(F.col("k_source")) & (F.col("bucket") == F.col("k_bucket"))
        inside = cut(placed.join(chosen, same, "left_semi").select("m_source", "m_size", "m_key"))
        if max(p[3] for p in parts) < 1e-12:  # equal keys, which no bucket tells apart
            placed = _beside(inside, [p[:5] for p in parts], "mean double, low double, width double, rest long")
            break
    inside = placed if parts else _beside(inside.limit(0), [], "rest long")
    by_key = inside.groupBy("m_source", "m_key", "rest").agg(F.sum("m_size").alias("words"), F.count("*").alias("n"))
    keys = {
        r.m_source: (r.m_key, (r.rest - r.start) // r.n, (2 * (r.rest - r.start) * r.n + r.words) // (2 * r.words), r.n)
        for r in crossing(by_key, "m_key").collect()
    }
    return [
        (r.m_source, size, target, e, *keys.get(r.m_source, (-1.0, 0, 0, 0)))
        for r, size, target, e in zip(found, sizes, targets, epochs, strict=True)
    ]


PLAN = "source_size long, target double, epochs long, cut_key double, cut_part long, cut_rows long, cut_all long"


def _taken(rows: DataFrame, plan: list[tuple]) -> DataFrame:
    part = F.when(F.col("m_key") < F.col("cut_key"), F.col("m_size"))
    part = part.when(F.col("m_key") == F.col("cut_key"), F.col("cut_part")).otherwise(F.lit(0))
    return _beside(rows, plan, PLAN).withColumn("taken", F.col("epochs") * F.col("m_size") + part)


def _whole(rows: DataFrame, plan: list[tuple], places: Sequence[str]) -> DataFrame:
    """``rows`` with ``copies``, the times each is taken whole; rows on a cut that are equal become one."""
    some = [p[0] for p in plan if 0 < p[-2] < p[-1]]  # sources that take part of several rows on their cut
    beside = _beside(rows, plan, PLAN)
    once_more = (F.col("m_key") < F.col("cut_key")) | ((F.col("m_key") == F.col("cut_key")) & (F.col("cut_rows") == F.col("cut_all")))
    times = F.when(F.col("m_size") == 0, 0).otherwise(F.col("epochs") + F.when(once_more, 1).otherwise(0))
    whole = beside.withColumn("copies", times.cast("int")).select(*places, "copies")
    if not some:
        return whole
    # one document's rows a source
    on_cut = _beside(rows, [p for p in plan if p[0] in some], PLAN).where("m_key = cut_key and m_size > 0")
    on_cut = on_cut.groupBy(*places, "m_source", "cut_rows").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("m_source").orderBy(*places).rowsBetween(Window.unboundedPreceding, 0))
    times = F.least(F.col("n"), F.greatest(F.lit(0), F.col("cut_rows") - (so_far - F.col("n"))))
    return whole.union(on_cut.withColumn("copies", times.cast("int")).select(*places, "copies"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, taken, source) of every row.

    ``weights`` repeat over the sources in code-point order. Totals and cuts per
    source, and counts of vote patterns, are all that reaches the driver. Texts are
    read once.
    """
    rows = _drawn(pick(docs, id_col, text_col, source_col).toDF("m_id", "m_text", "m_source"), "m_id", "m_text", seed)
    drawn = stored(rows.select("m_id", "m_source", "m_stats", "m_draw"), "mixing")
    keyed = _keyed(drawn, fit_rules(drawn, RULES, "m_stats"))
    return _taken(keyed, plan_mix(keyed, weights, share, most)).select(
        F.col("m_id").alias(id_col),
        F.col("m_size").alias("size"),
        "source_size",
        "target",
        "taken",
        F.col("m_source").alias(source_col),
    )


def mixed_corpus(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    whole: bool = False,
) -> DataFrame:
    """The mix itself: each row of ``docs`` once per time taken, all columns kept.

    With ``whole`` the document on a source's cut is taken or left whole, whichever
    ends nearer the target; else it comes, as its last copy, with its first words
    only, to the count of ``mix_sources``. Sizes and keys are read off the texts
    again rather than joined to them.
    """
    places = [f"c{i}" for i in range(len(docs.columns))]
    text = places[docs.columns.index(text_col)]
    rows = docs.toDF(*places).withColumn("m_source", F.col(places[docs.columns.index(source_col)]))
    rows = _drawn(rows, places[docs.columns.index(id_col)], text, seed)
    drawn = stored(rows.select("m_source", "m_stats", "m_draw"), "mixing")
    model = fit_rules(drawn, RULES, "m_stats")
    plan = plan_mix(_keyed(drawn, model), weights, share, most)
    rows = _keyed(rows, model)
    if whole:
        told = _whole(rows, plan, places).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        return told.select(*places).toDF(*docs.columns)
    told = _taken(rows, plan).where(F.col("taken") > 0)
    told = told.withColumn("copy", F.explode(F.expr("sequence(1L, cast(ceil(taken / m_size) as bigint))")))
    words = F.col("taken") - (F.col("copy") - 1) * F.col("m_size")
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    told = told.withColumn(text, F.when(words >= F.col("m_size"), F.col(text)).otherwise(first))
    return told.select(*places).toDF(*docs.columns)
