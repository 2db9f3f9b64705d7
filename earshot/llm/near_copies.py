"""Near-dedup: SimHash groups first, completed by the exact similarity of word shingles.

Texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 at least, or are linked over such pairs. SimHash fingerprints of
the same shingles, linked by anchor-point covering (``simhash``), propose the first
pairs. At this similarity fingerprints differ in about ten bits, far beyond what a
covering can hold, so prefix lists complete the candidates: the shingles of a set
are put in one order for all sets, and two sets of this similarity share one of the
first fifth (and one) of each, so lists of the sets that hold a shingle there meet
all pairs. The order puts shingles last that many texts hold, by hashed counters
over all texts; it changes the length of the lists, never what is found. Every
candidate is held against the exact similarity.

Equal sets are one node. Lists are not paired in full at once: in the first rounds
each node meets one other, and once the representative of its SimHash group, and
only what these links leave in different components meets all others whose size and
place in the list let them be similar. The first
round names the member of a list that holds the fewest rarer shingles, which is the
text that a group of edited copies comes from, so most of a group is linked at once.
Every node carries one bit for each class of shingle hashes, set if it holds an odd
number of them. Two sets differ in as many shingles at least as these bits differ,
so pairs that cannot be similar end inside the join, before any set is read, and
none that can be is lost. A large group of near copies so costs its size, not the
square of it.

Defined results: words are split at ASCII white space, ASCII letters lower-cased; a
text of fewer than five words is one shingle; a null text or one without words has
no shingle, and all of these are one group; of a group the row with the smallest id
stays, a null id being larger than any other; an empty table gives an empty result;
all columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, dealt, stored
from .graph import components
from .simhash import SEED, fingerprint_of, near_links, shingle_hashes

SHINGLE = 5
COUNTERS = 1 << 20  # hashed counts of the texts that hold a shingle
OFTEN = 16  # times the mean counter, from which a shingle's list is salted
SALTS = 64
HELD_SHINGLES = 1 << 18  # that a task holds before it counts them
SLICE = 256  # texts whose sets a worker holds at once
ROUNDS = 2  # in which nodes meet one or two others, before all others
MOST_BITS = 1 << 27  # of a filter of row marks: 16 MB
MARK_BITS = 32  # of a filter, a mark, as long as that is not more
WORDS = 4  # longs of parity bits of a set
SEGMENTS = 64  # pieces in which counters and filters are merged


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    return np.unique(shingle_hashes(text, size).view("<i8"))


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view("<i8"))


def parities(found: np.ndarray) -> np.ndarray:
    """Whether a set holds an odd number of the hashes of each of 64 * ``WORDS`` classes, as signed longs."""
    classes = (found >> 24) & (64 * WORDS - 1)
    odd = np.bincount(classes, minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefixes(sets: list[np.ndarray], counters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, shingle, place) of the first shingles of each set, rare ones first.

    Of n shingles, n - ceil(0.8 n) + 1: a set of similarity 0.8 lacks fewer.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((flat, counters[flat & (COUNTERS - 1)], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place < (sizes - (4 * sizes + 4) // 5 + 1)[owner]
    return owner[kept], flat[order][kept], place[kept]


def _slices(batches: Iterator[pd.DataFrame], size: int, bits: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The sets of the rows (mark, text) whose mark the filter holds.

    The filter is asked beside the sets, so that a task runs one Python worker.
    """
    for batch in batches:
        first, second = _places(batch["mark"].to_numpy(np.int64), 8 * len(bits))
        at = lambda p: (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1
        texts = batch["text"][(at(first) & at(second)).astype(bool)].tolist()
        for k in range(0, len(texts), SLICE):
            yield [shingles(t, size) for t in texts[k : k + SLICE]]


def _prints(rows: DataFrame, size: int) -> DataFrame:
    """(id, hash, node, fp, odd) of each of ``rows`` (id, hash, text), and rows (segment, counts) of a task's counters."""
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField("hash", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("fp", T.LongType()),
            T.StructField("odd", T.ArrayType(T.LongType())),
            T.StructField("segment", T.IntegerType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.uint32)
        held: list[np.ndarray] = []
        width, id_type = 0, None

        def settle() -> None:
            nonlocal width
            places, times = np.unique(np.concatenate(held) & (COUNTERS - 1), return_counts=True)
            counters[places] += times.astype(np.uint32)
            held.clear()
            width = 0

        for batch in batches:
            id_type = batch.schema.field("id").type
            nodes, prints, odd = [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), size)
                found = np.unique(hashes.view("<i8"))
                nodes.append(node_of(found))
                prints.append(fingerprint_of(hashes))
                odd.append(parities(found))
                held.append(found)
                width += len(found)
                if width >= HELD_SHINGLES:
                    settle()
            n = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("hash"),
                    pa.array(nodes, pa.int64()),
                    pa.array(prints, pa.int64()),
                    pa.array(odd, pa.list_(pa.int64())),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                names=schema.names,
            )
        if held:
            settle()
        if id_type is not None:
            packed = [zlib.compress(part.tobytes(), 1) for part in np.split(counters, SEGMENTS)]
            longs = [*[pa.nulls(SEGMENTS, pa.int64())] * 3, pa.nulls(SEGMENTS, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SEGMENTS, id_type), *longs, pa.array(range(SEGMENTS), pa.int32()), pa.array(packed, pa.binary())], names=schema.names
            )

    return rows.mapInArrow(of, schema)


def _merged_counters(parts: DataFrame) -> np.ndarray:
    """The sums of all tasks' counters, 4 MB, on the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, packed in zip(batch["segment"], batch["counts"], strict=True):
                counts = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
                held[segment] = held[segment] + counts if segment in held else counts
        for segment, counts in held.items():
            small = np.minimum(counts, np.uint64((1 << 32) - 1)).astype(np.uint32)
            yield pd.DataFrame({"segment": [segment], "counts": [zlib.compress(small.tobytes(), 1)]})

    whole = np.zeros(COUNTERS, np.uint32)
    pieces = np.split(whole, SEGMENTS)
    for row in parts.repartition(SEGMENTS, "segment").mapInPandas(add, "segment int, counts binary").collect():
        pieces[row.segment][:] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return whole


def _lists(hashes: DataFrame, rows: DataFrame, counters: np.ndarray, size: int) -> DataFrame:
    """(token, node, n, place) of the first shingles that several nodes share.

    Of the ``rows`` (mark, text) those with these ``hashes`` (hash) as mark count. A list is short unless its shingle's counter is high; lists that may be long
    are dealt over salts and kept without a look at their other members.
    """
    order = rows.sparkSession.sparkContext.broadcast((counters, _filter(hashes)))
    high = max(1000, OFTEN * int(counters.mean()))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters, bits = order.value
        for found in _slices(batches, size, bits):
            owner, token, place = prefixes(found, counters)
            nodes = np.array([node_of(s) for s in found], np.int64)[owner]
            sizes = np.array([len(s) for s in found], np.int64)[owner]
            often = counters[token & (COUNTERS - 1)] >= high
            yield pd.DataFrame({"token": token, "node": nodes, "n": sizes, "place": place, "salt": np.where(often, 1 + nodes % SALTS, 0)})

    entries = rows.select("mark", "text").mapInPandas(spread, "token long, node long, n int, place int, salt int")
    of_list = Window.partitionBy("token", "salt")
    entries = entries.withColumn("low", F.min("node").over(of_list)).withColumn("high", F.max("node").over(of_list))
    shared = entries.where("salt > 0 or low < high")
    lists = stored(shared.select("token", "node", "n", "place").distinct(), "lists")
    order.destroy()
    return lists


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.int64(bits - 1)
    return hashes & mask, (hashes >> 32) & mask


def _filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``hash`` on the driver, as large as their number asks and the bound lets."""
    size = min(MOST_BITS, 1 << max(16, (MARK_BITS * hashes.count()).bit_length()))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(size >> 3, np.uint8)
        for batch in batches:
            for place in _places(batch["hash"].to_numpy(np.int64), size):
                np.bitwise_or.at(held, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        for k, part in enumerate(np.split(held, SEGMENTS)):
            if part.any():
                yield pd.DataFrame({"segment": [k], "bits": [zlib.compress(part.tobytes(), 1)]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, packed in zip(batch["segment"], batch["bits"], strict=True):
                bits = np.frombuffer(zlib.decompress(packed), np.uint8)
                held[segment] = held[segment] | bits if segment in held else bits
        for segment, bits in held.items():
            yield pd.DataFrame({"segment": [segment], "bits": [zlib.compress(bits.tobytes(), 1)]})

    whole = np.zeros(size >> 3, np.uint8)
    pieces = np.split(whole, SEGMENTS)
    schema = "segment int, bits binary"
    for row in hashes.mapInPandas(fill, schema).repartition(SEGMENTS, "segment").mapInPandas(join, schema).collect():
        pieces[row.segment][:] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return whole


def _sets_of(hashes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(node, set) of the rows (mark, text) with these ``hashes`` (hash) as mark, and of few others.

    The sets are read off the texts again, without a shuffle of them.
    """
    held = rows.sparkSession.sparkContext.broadcast(_filter(hashes))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in _slices(batches, size, held.value):
            yield pd.DataFrame({"node": [node_of(s) for s in found], "set": found})

    sets = stored(rows.select("mark", "text").mapInPandas(of, "node long, set array<long>"), "sets")
    held.destroy()
    return sets


def _similar(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 at least."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets_of(nodes.join(dealt(ends), "node", "left_semi").select("hash"), rows, size)
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}")), end)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(9 * common >= 4 * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _labelled(lists: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return lists.withColumn("label", F.col("node"))
    labels = components(links).select(F.col("node").alias("at"), "label")
    return lists.join(dealt(labels), F.col("node") == F.col("at"), "left").select(*lists.columns, F.coalesce("label", "node").alias("label"))


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def print_pairs(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b): each node of ``nodes`` (node, fp) beside the representative of its SimHash group."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    labels = components(near_links(prints.select("fp"), threshold)).select(F.col("node").alias("at"), "label")
    named = prints.join(dealt(labels), F.col("fp") == F.col("at"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    heads = stored(named.groupBy("label").agg(F.min("first").alias("head")).join(dealt(named), "label").select(F.col("fp").alias("h_fp"), "head"), "heads")
    beside = nodes.join(dealt(heads), F.col("fp") == F.col("h_fp")).where("node <> head")
    return beside.select(*_pair("node", "head"))


def meeting(told: DataFrame, one: DataFrame) -> DataFrame:
    """Members of each list beside those of ``one`` whose sizes and places in the list let them be similar.

    The shapes (size, place) of a list's members are compared first, each once, and only
    sizes that may be similar at all; members meet only where their shapes fit. Pages of one
    template, of which too much is their own, have shapes that do not fit one another.
    """
    step = math.log(1.25)  # similar sets differ by this factor at most
    band = lambda size: F.floor(F.log(F.greatest(F.col(size), F.lit(1))) / step).cast("int")
    mine = told.select("token", "n", "place").distinct().withColumn("band", band("n"))
    theirs = one.select("token", "m", "o_place").distinct().withColumn("band", F.explode(F.array(*[band("m") + k for k in (-1, 0, 1)])))
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("o_place"))
    fits = mine.join(dealt(theirs), ["token", "band"]).where(9 * most >= 4 * (F.col("n") + F.col("m"))).drop("band")
    fits = stored(fits, "shapes")
    return told.join(dealt(fits), ["token", "n", "place"]).join(dealt(one), ["token", "m", "o_place"])


def similar_links(lists: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(a, b), a < b, that join the ``nodes`` (node, hash, fp, odd) over all similar pairs.

    Of the ``rows`` (mark, text), ``nodes.hash`` is the mark of one row a node.
    """
    other = {"node": "other", "n": "m", "place": "o_place", "odd": "o_odd", "label": "o_label"}
    lists = stored(lists.join(dealt(nodes.select("node", "odd")), "node"), "lists")
    # enough is left if no shingle before this one is shared, and the sizes fit
    most = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("o_place"))
    sizes = F.col("n") + F.col("m")
    differ = reduce(Column.__add__, [F.bit_count(F.col("odd")[w].bitwiseXOR(F.col("o_odd")[w])) for w in range(WORDS)])
    fit = (F.col("label") != F.col("o_label")) & (9 * most >= 4 * sizes) & (9 * differ <= sizes)
    found: list[DataFrame] = []
    met: list[DataFrame] = []
    for k in range(ROUNDS + 1):
        told = stored(_labelled(lists, reduce(DataFrame.union, found)), "labelled") if found else _labelled(lists, None)
        if k < ROUNDS:  # one member of each list, another one each round
            rarer = F.col("place") if k == 0 else F.lit(0)
            draw = F.struct(rarer.alias("rarer"), F.xxhash64(F.lit(k), "node").alias("draw"), *other)
            one = told.groupBy("token").agg(F.min(draw).alias("o"))
            one = stored(one.select("token", *[F.col(f"o.{a}").alias(b) for a, b in other.items()]), "ones")
            best = F.min(F.struct((differ / sizes).alias("apart"), F.xxhash64("other").alias("tie"), "other")).alias("best")
            pairs = told.join(dealt(one), "token").where(fit).groupBy("node").agg(best).select(*_pair("node", "best.other"))
            if k == 0:
                pairs = pairs.union(print_pairs(nodes))
            pairs = pairs.distinct()
        else:  # each member beyond its list's largest component beside all others
            main = told.groupBy("token", "label").count().groupBy("token").agg(
                F.max(F.struct("count", "label")).alias("main"), F.count("*").alias("labels")
            )
            main = stored(main.where("labels > 1").select("token", F.col("main.label").alias("main")), "main")
            one = told.join(dealt(main), "token").where(F.col("label") != F.col("main"))
            one = stored(one.select("token", *[F.col(a).alias(b) for a, b in other.items()]), "apart")
            pairs = meeting(told, one).where(fit).select(*_pair("node", "other")).distinct()
        if met:  # no pair is held against its sets twice
            pairs = pairs.join(dealt(reduce(DataFrame.union, met)), ["a", "b"], "left_anti")
        pairs = stored(pairs, "candidates")
        met.append(pairs)
        found.append(cut(_similar(pairs, nodes, rows, size)))
    return reduce(DataFrame.union, found)


def without_near_copies(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of near copies: the one with the smallest id.

    Ids and text hashes of the rows that stay are joined to the rows; the texts are
    shuffled once.
    """
    places = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*places)
    at_id, at_text = places[docs.columns.index(id_col)], places[docs.columns.index(text_col)]
    text_hash = F.xxhash64(at_text)
    rows = flat.select(F.xxhash64(F.col(at_id), text_hash).alias("mark"), F.col(at_text).alias("text"))
    told = stored(_prints(flat.select(F.col(at_id).alias("id"), text_hash.alias("hash"), F.col(at_text).alias("text")), size), "prints")
    counters = _merged_counters(told.where("segment is not null").select("segment", "counts"))
    prints = told.where("segment is null").select("id", "hash", "node", "fp", "odd")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "hash", "fp", "odd")
    nodes = stored(prints.groupBy("node").agg(F.min(order).alias("least")), "nodes")
    marks = nodes.select("node", F.xxhash64("least.id", "least.hash").alias("hash"), "least.fp", "least.odd")
    lists = _lists(marks.select("hash"), rows, counters, size)
    links = similar_links(lists, rows, marks, size)
    labels = components(links).select(F.col("node").alias("at"), "label")
    marked = nodes.join(dealt(labels), F.col("node") == F.col("at"), "left")
    least = marked.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("least").alias("least"))
    stay = stored(least.select(F.col("least.id").alias("s_id"), F.col("least.hash").alias("s_hash")), "stay")
    same = F.col(at_id).eqNullSafe(F.col("s_id")) & (F.xxhash64(at_text) == F.col("s_hash"))
    left = flat.join(dealt(stay), same, "left_semi")
    twice = prints.groupBy("id", "hash").count().where("count > 1")
    if not twice.isEmpty():  # of rows that share id and text the first by all their columns stays
        told = left.withColumns({"told": F.to_json(F.struct(*places)), "hash": text_hash})
        told = stored(told.withColumn("told", F.sha2("told", 256)), "told")
        first = told.groupBy(F.col(at_id).alias("f_id"), F.col("hash").alias("f_hash")).agg(F.min("told").alias("f_told"))
        same = F.col(at_id).eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash")) & (F.col("told") == F.col("f_told"))
        left = told.join(first, same, "left_semi").select(*places).dropDuplicates([at_id, at_text])
    return left.toDF(*docs.columns)
