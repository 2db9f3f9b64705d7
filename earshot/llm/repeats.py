"""Exact removal of long repeated byte strings.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere, in the
same or another document, is removed; strings are judged on the input.

How occurrences of a string meet without sorting all suffixes of the corpus:

1. Each window of LENGTH bytes has one *anchor*, its leftmost 64-byte gram of
   smallest hash. That depends on the window's bytes only, so equal windows have
   equal anchors at equal offsets, and neighbouring windows share theirs: about
   one anchor in 170 bytes. An anchor's windows are compared with those of equal
   anchors only.
2. Anchors whose windows' bytes are equal as a whole are repeats as a whole;
   anchors that stand once are not. This settles most by counting hashes.
3. The distinct rest is cut in ranges of window offsets. All windows of a range
   hold the range's *core*, so a core hash that stands once settles the range.
4. The suffixes of what remains, left edge, core as one symbol, right edge, are
   sorted group by group by linear grouping (``suffix_sort``): a window is
   repeated if its neighbour in suffix order shares the range's width.
   Groups of more than ``GROUP_ROWS`` distinct strings are settled window by
   window, by counting hashes, so no group is gathered in a task.

Bytes are compared through 128-bit hashes of them, so a false repeat needs a
collision of those.

Defined results: a null text is empty; repeated rows repeat each other; texts
shorter than LENGTH bytes stay; an empty table gives an empty result; very long
texts are taken in stretches of ``STRETCH`` windows, with the same result; other
columns are ignored. Rows are known by two hashes of id and text, so ids of any type,
nulls among them, stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, stored, utf8
from .suffix_sort import suffix_order

LENGTH = 400
GRAM = 64
SPAN = LENGTH - GRAM + 1  # gram places in a window
WIDTH = 22  # offsets in a range
STRETCH = 1 << 22
GROUP_ROWS = 128
SORT_ROWS = 4096  # strings that a task sorts, about
BATCH_SYMBOLS = 1 << 16
PLACE_BITS = 23  # a place within a stretch and its last window

MARK = ("m1", "m2")  # of a row: hashes of its id and text

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_HASH = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling."""
    hashes, size, factor = _BYTE_HASH[data], 1, int(_MULTIPLIER)
    while size < GRAM:
        hashes = hashes[:-size] + np.uint64(factor) * hashes[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    hashes ^= hashes >> np.uint64(31)
    hashes *= _MULTIPLIER
    return hashes ^ (hashes >> np.uint64(29))


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest of each SPAN consecutive hashes."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = SPAN - size
    least = np.minimum(least[: len(least) - rest], least[rest:])
    return (least & low).astype(np.int64)


def text_anchors(raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first window, last window, anchor, gram hash, hash of the bytes) of each anchor of a text."""
    for begin in range(0, len(raw) - LENGTH + 1, STRETCH):
        data = np.frombuffer(raw, np.uint8, min(STRETCH + LENGTH - 1, len(raw) - begin), begin)
        hashes = gram_hashes(data)
        anchors = window_anchors(hashes)
        starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        ends = np.concatenate((starts[1:], [len(anchors)])) - 1
        places = anchors[starts]
        grams = hashes[places].view(np.int64)
        for lo, hi, at, gram in zip(starts.tolist(), ends.tolist(), places.tolist(), grams.tolist(), strict=True):
            lo, hi, at = lo + begin, hi + begin, at + begin
            yield lo, hi, at, gram, xxhash.xxh3_128_digest(raw[lo : hi + LENGTH])


ANCHORS = T.StructType(
    [
        T.StructField("lo", T.IntegerType()),
        T.StructField("hi", T.IntegerType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("gram", T.LongType()),
        T.StructField("bytes", T.BinaryType()),
        T.StructField("times", T.IntegerType()),
    ]
)


def within_text(anchors: Iterator[tuple[int, int, int, int, bytes]]) -> list[tuple]:
    """One row, with its number of times, for all equal anchors of a text.

    What a text itself repeats is settled here: such windows come as rows of no
    times, runs of neighbours joined, so that periodic texts give few rows.
    """
    places: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    for lo, hi, at, gram, digest in anchors:
        places.setdefault((gram, digest), []).append((lo, hi, at))
    rows = []
    for (gram, digest), found in places.items():
        rows.append((*found[0], gram, digest, len(found)))
        if len(found) > 1:
            first, last = found[0][:2]
            for lo, hi, _ in found[1:]:
                if lo > last + 1:
                    rows.append((first, last, 0, 0, b"", 0))
                    first = lo
                last = hi
            rows.append((first, last, 0, 0, b"", 0))
    return rows


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for m1, m2, text in zip(batch["m1"], batch["m2"], batch["d_text"], strict=True):
            raw = (text or "").encode()
            if len(raw) >= LENGTH:
                rows += [(m1, m2, *found) for found in within_text(text_anchors(raw))]
        yield pd.DataFrame(rows, columns=[*MARK, *ANCHORS.names])


def ranges(raw: bytes, lo: int, hi: int, at: int) -> Iterator[tuple]:
    """(range, core hash, hash of all, first window, last window, left edge, right edge) of an anchor.

    Offsets count from a window's start to the anchor. A range's windows all hold
    the bytes from its smallest offset before the anchor to LENGTH minus its
    largest after it.
    """
    for r in range((at - hi) // WIDTH, (at - lo) // WIDTH + 1):
        near, far = r * WIDTH, r * WIDTH + WIDTH - 1
        s, e = max(lo, at - far), min(hi, at - near)
        a, b = at - near, at + LENGTH - far
        core = xxhash.xxh3_128_digest(raw[a:b])
        whole = xxhash.xxh3_128_digest(raw[s : e + LENGTH], (at - s) * LENGTH + (at - e))
        yield r, core, whole, s, e, raw[s:a], raw[b : e + LENGTH]


PARTS = T.StructType(
    [
        T.StructField("gram", T.LongType()),
        T.StructField("range", T.IntegerType()),
        T.StructField("core", T.BinaryType()),
        T.StructField("whole", T.BinaryType()),
        T.StructField("s", T.IntegerType()),
        T.StructField("e", T.IntegerType()),
        T.StructField("left", T.BinaryType()),
        T.StructField("right", T.BinaryType()),
        T.StructField("done", T.BooleanType()),
    ]
)


def _cut_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for m1, m2, text, reps in zip(batch["m1"], batch["m2"], batch["d_text"], batch["reps"], strict=True):
            raw = text.encode()
            rows = [
                (m1, m2, rep["gram"], *part, rep["done"])
                for rep in reps
                for part in ranges(raw, rep["lo"], rep["hi"], rep["at"])
            ]
            yield pd.DataFrame(rows, columns=[*MARK, *PARTS.names])


def repeated_starts(groups: list[list[tuple[bytes, bytes]]]) -> list[list[np.ndarray]]:
    """For each (left, right) of each group, which of its windows another of the group repeats.

    All strings of all groups are put behind one another, a core being a symbol of
    its group and a separator of its own closing each string, and their suffixes
    sorted at once. A window of the range spans WIDTH symbols.
    """
    symbols: list[int] = []
    spots = []
    strings = sum(map(len, groups))
    stop = 1
    for k, group in enumerate(groups):
        core = strings + 257 + k
        for left, right in group:
            spots.append((len(symbols), len(left), len(right)))
            symbols += [b + strings + 1 for b in left]
            symbols.append(core)
            symbols += [b + strings + 1 for b in right]
            symbols.append(stop)
            stop += 1
    symbols.append(0)
    order = np.array(suffix_order(symbols))
    padded = np.concatenate((np.array(symbols), np.full(WIDTH, -1)))
    views = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[order]
    equal = (views[1:] == views[:-1]).all(1)
    repeated = np.zeros(len(symbols), bool)
    repeated[order[1:][equal]] = True
    repeated[order[:-1][equal]] = True
    out, at = [], 0
    for group in groups:
        found = []
        for left, right in group:
            begin, n, m = spots[at]
            at += 1
            # windows start in the left edge or on the core, and end inside the string
            found.append(np.flatnonzero(repeated[begin : begin + n + 1 + m - WIDTH + 1]))
        out.append(found)
    return out


def runs(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive places."""
    if len(places):
        cuts = np.flatnonzero(np.diff(places) > 1)
        for a, b in zip([0, *(cuts + 1)], [*cuts, len(places) - 1], strict=True):
            yield int(places[a]), int(places[b])


def _settled(held: list[list[tuple]]) -> pd.DataFrame:
    found = repeated_starts([[(r.left, r.right) for r in group] for group in held])
    rows = [
        (r.m1, r.m2, r.s + a, r.s + b + LENGTH)
        for group, starts in zip(held, found, strict=True)
        for r, places in zip(group, starts, strict=True)
        if not r.done
        for a, b in runs(places)
    ]
    return pd.DataFrame(rows, columns=[*MARK, "s", "t"], dtype="int64")


def _sort_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settle groups that come row after row; a batch of groups is sorted at once."""
    held: list[list[tuple]] = []
    key, size = None, 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            own = (row.gram, row.range, row.core)
            if own != key:
                if size > BATCH_SYMBOLS:
                    yield _settled(held)
                    held, size = [], 0
                held.append([])
                key = own
            held[-1].append(row)
            size += len(row.left) + len(row.right) + 2
    if held:
        yield _settled(held)


def _each_window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A hash of every window of every row of a large group."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            places = range(row.e - row.s + 1)
            ends = len(row.right) - (row.e - row.s)
            digests = [xxhash.xxh3_128_digest(row.left[p:] + row.core + row.right[: ends + p], len(row.left) - p) for p in places]
            yield pd.DataFrame(
                {"m1": row.m1, "m2": row.m2, "s": [row.s + p for p in places], "done": row.done, "window": digests}
            )


KEPT = T.StructType(
    [
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("kept", T.BinaryType()),
    ]
)


@F.pandas_udf(KEPT)
def _without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, cut in zip(texts, spans, strict=True):
        if cut is None:
            out.append((0, [], None))
            continue
        raw, kept, at, joined = text.encode(), [], 0, []
        for s, t in sorted((x["s"], x["t"]) for x in cut):
            if joined and s <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], t)
            else:
                joined.append([s, t])
        for s, t in joined:
            kept.append(raw[at:s])
            at = t
        kept.append(raw[at:])
        out.append((sum(t - s for s, t in joined), joined, b"".join(kept)))
    return pd.DataFrame(out, columns=KEPT.names)


def _wide(schema: T.StructType) -> T.StructType:
    return T.StructType([*(T.StructField(m, T.LongType()) for m in MARK), *schema.fields])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(m1, m2, s, t): byte spans of rows (m1, m2, d_text) that repeats cover."""
    found = stored(rows.mapInPandas(_find_anchors, _wide(ANCHORS)), "anchors")
    anchors = found.where("times > 0")
    # anchors that stand twice, and whether with different bytes around
    grams = anchors.groupBy("gram").agg(F.sum("times").alias("n"), F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    grams = stored(grams.where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("differs")), "grams")
    shared = stored(anchors.join(grams, "gram"), "shared")
    first = F.struct(*MARK, "lo", "hi", "at")
    kinds = shared.groupBy("gram", "bytes").agg(F.sum("times").alias("n"), F.max("differs").alias("differs"), F.min(first).alias("rep"))
    kinds = stored(kinds, "kinds")
    equal = kinds.where("n > 1").select("gram", "bytes")
    spans = shared.join(equal, ["gram", "bytes"]).select(*MARK, "lo", (F.col("hi") + LENGTH).alias("t"))
    own = found.where("times = 0").select(*MARK, "lo", (F.col("hi") + LENGTH).alias("t"))
    spans = spans.union(own).withColumnRenamed("lo", "s")
    reps = kinds.where("differs").select("rep.*", "gram", (F.col("n") > 1).alias("done"))
    told = reps.groupBy(*MARK).agg(F.collect_list(F.struct("lo", "hi", "at", "gram", "done")).alias("reps"))
    parts = rows.join(stored(told, "reps"), [*MARK]).mapInPandas(_cut_ranges, _wide(PARTS))
    parts = stored(parts, "parts")
    key = ["gram", "range", "core"]
    cores = parts.groupBy(*key).agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    cores = stored(cores.where("n > 1").select(*key, (F.col("a") != F.col("b")).alias("differs")), "cores")
    close = stored(parts.join(cores, key), "close")
    first = F.struct(*MARK, "s", "e", "left", "right", "done")
    wholes = close.groupBy(*key, "whole").agg(F.count("*").alias("n"), F.max("differs").alias("differs"), F.min(first).alias("rep"))
    wholes = stored(wholes, "wholes")
    equal = wholes.where("n > 1").select(*key, "whole")
    ranged = close.where(~F.col("done")).join(equal, [*key, "whole"])
    spans = spans.unionByName(ranged.select(*MARK, "s", (F.col("e") + LENGTH).alias("t")))
    rest = wholes.where("differs").select(
        *key, *[f"rep.{m}" for m in MARK], "rep.s", "rep.e", "rep.left", "rep.right", (F.col("rep.done") | (F.col("n") > 1)).alias("done")
    )
    large = stored(wholes.where("differs").groupBy(*key).count().where(F.col("count") > GROUP_ROWS).select(*key), "large")
    small = rest.join(large, key, "left_anti")
    # sorting costs by strings and not by bytes: the tasks are counted by strings
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), wholes.where("differs").count() // SORT_ROWS + 1)
    by_group = small.repartition(tasks, *key).sortWithinPartitions(*key)
    decided = by_group.mapInPandas(_sort_groups, _wide(SPANS))
    spans = spans.unionByName(decided)
    windows = stored(rest.join(large, key, "left_semi").mapInPandas(_each_window, _wide(WINDOWS)), "windows")
    twice = stored(windows.groupBy("window").count().where("count > 1").select("window"), "twice")
    single = windows.where(~F.col("done")).join(twice, "window")
    return spans.unionByName(single.select(*MARK, "s", (F.col("s") + LENGTH).alias("t")))


SPANS = T.StructType([T.StructField("s", T.LongType()), T.StructField("t", T.LongType())])
WINDOWS = T.StructType(
    [T.StructField("s", T.LongType()), T.StructField("done", T.BooleanType()), T.StructField("window", T.BinaryType())]
)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) of every row.

    ``spans`` are the removed runs, (start, end) in bytes; ``kept`` is binary, as cuts
    may split a code point.
    """
    rows = pick(docs, id_col, text_col).toDF("d_id", "d_text")
    rows = rows.withColumns({"m1": F.xxhash64("d_id", "d_text"), "m2": F.xxhash64(F.lit(GRAM), "d_text", "d_id")})
    spans = repeated_spans(rows.select(*MARK, "d_text"))
    by_doc = stored(spans.groupBy(*MARK).agg(F.collect_set(F.struct("s", "t")).alias("found")), "spans")
    told = rows.join(by_doc, [*MARK], "left").withColumn("told", _without("d_text", "found"))
    return told.select(
        F.col("d_id").alias(id_col),
        F.coalesce(F.octet_length("d_text"), F.lit(0)).cast("long").alias("n_bytes"),
        "told.n_removed",
        "told.spans",
        F.coalesce("told.kept", utf8(F.col("d_text"))).alias("kept"),
    )


def repeat_digest(docs: DataFrame) -> DataFrame:
    """Byte and span counts and the digest of what is kept, per document; then the removed runs and the kept text.

    In ``kept_text`` a code point that a cut splits is shown by a replacement character.
    """
    found = remove_repeats(docs)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("repeated"),
        F.expr("array_join(transform(spans, s -> concat_ws(':', s[0], s[1])), ',')").alias("removed_spans"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )
