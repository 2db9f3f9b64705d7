"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles. Anchors are the words of a
product of binary Golay codes over the first bits of a fingerprint: every 23-bit
block lies within covering radius 3 of exactly one code word, its home. A
fingerprint is replicated to every anchor within the covering radius plus the
threshold, the excess over the radius summed over blocks; two fingerprints that
differ in at most ``threshold`` bits therefore meet at the home of either, where
they are compared. Equal fingerprints are one node before any of this, so exact
copies never multiply.

Two blocks give 2**24 anchors and about 61 replicas of a fingerprint at threshold
2. Beyond as many fingerprints, bits after the blocks are added to the anchors, one
each time the fingerprints double (their code is every word, of covering radius 0),
so that the fingerprints of an anchor stay as few; six more bits cost 105 more
replicas. A fingerprint has at most 2,080 others within 2 bits, which bounds the links.

Defined results: a null text or one without words has fingerprint 0, linked like
any other; repeated rows and rows with null ids are fingerprinted row by row; a
component of null ids only has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, dealt, pick, stored
from .graph import components

SEED = 42
ANCHORS = 1 << 24  # of two blocks; more fingerprints take bits besides
PRINTS = 1 << 10  # fingerprints that a task replicates at once
CHUNK = 1 << 16  # hashes whose bits are spread out at once

# The binary Golay code.
LENGTH, RADIUS, GENERATOR = 23, 3, 0b101011100011


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of one text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype="<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that over half the hashes set, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def simhash(text: str | None, shingle: int) -> int:
    """Fingerprint of one text, as a signed 64-bit integer."""
    return fingerprint_of(shingle_hashes(text, shingle))


def _syndrome(word: int) -> int:
    for k in range(LENGTH - 1, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


@lru_cache(maxsize=1)
def _cosets(threshold: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Syndromes of the high and low part of a word; per excess 0..threshold the
    error patterns of each syndrome, as offsets into one array."""
    high = np.array([_syndrome(v << 12) for v in range(1 << 11)], np.int64)
    low = np.array([_syndrome(v) for v in range(1 << 12)], np.int64)
    unit = [_syndrome(1 << k) for k in range(LENGTH)]
    classes = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
        pairs = []
        for w in weights:
            for places in combinations(range(LENGTH), w):
                syndrome = pattern = 0
                for k in places:
                    syndrome ^= unit[k]
                    pattern |= 1 << k
                pairs.append((syndrome, pattern))
        pairs.sort()
        syndromes = np.array([p[0] for p in pairs])
        offsets = np.searchsorted(syndromes, np.arange((1 << 11) + 1))
        classes.append((offsets, np.array([p[1] for p in pairs], np.int64)))
    return high, low, classes


def anchors(fingerprints: np.ndarray, blocks: int, threshold: int, extra: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every replica; home marks the anchor within the covering radius."""
    high, low, classes = _cosets(threshold)
    rows = np.arange(len(fingerprints))
    anchor = np.zeros(len(rows), np.int64)
    spent = np.zeros(len(rows), np.int64)
    values = fingerprints.astype(np.uint64)
    for b in range(blocks):
        word = ((values >> np.uint64(LENGTH * b)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        syndrome = high[word >> 12] ^ low[word & 0xFFF]
        parts = []
        for excess, (offsets, patterns) in enumerate(classes):
            able = np.flatnonzero(spent + excess <= threshold)
            first = offsets[syndrome[rows[able]]]
            count = offsets[syndrome[rows[able]] + 1] - first
            source = np.repeat(able, count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            code = word[rows[source]] ^ patterns[np.repeat(first, count) + within]
            parts.append((rows[source], anchor[source] << LENGTH | code, spent[source] + excess))
        rows, anchor, spent = (np.concatenate(x) for x in zip(*parts, strict=True))
    if extra:
        word = ((values >> np.uint64(LENGTH * blocks)) & np.uint64((1 << extra) - 1)).astype(np.int64)
        parts = []
        for weight in range(threshold + 1):
            able = np.flatnonzero(spent + weight <= threshold)
            for places in combinations(range(extra), weight):
                code = word[rows[able]] ^ sum(1 << k for k in places)
                parts.append((rows[able], anchor[able] << extra | code, spent[able] + weight))
        rows, anchor, spent = (np.concatenate(x) for x in zip(*parts, strict=True))
    return rows, anchor, spent == 0


def _fingerprint(shingle: int):
    @F.pandas_udf(T.LongType())
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return fingerprint


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, fp a signed long."""
    return pick(docs, id_col, text_col).select(id_col, _fingerprint(shingle)(text_col).alias("fp"))


def near_links(nodes: DataFrame, threshold: int = 2, blocks: int = 2) -> DataFrame:
    """(a, b) with a < b of all distinct fingerprints ``nodes.fp`` at most ``threshold`` bits apart."""
    extra = min(64 - LENGTH * blocks, max(0, math.ceil(math.log2(max(1, nodes.count()) / ANCHORS))))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PRINTS):
                some = batch["fp"].to_numpy()[at : at + PRINTS]
                rows, anchor, home = anchors(some, blocks, threshold, extra)
                yield pd.DataFrame({"anchor": anchor, "fp": some[rows], "home": home})

    copies = nodes.mapInPandas(spread, "anchor long, fp long, home boolean")
    homes = copies.where("home").select("anchor", F.col("fp").alias("a"))
    visitors = copies.select("anchor", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return homes.join(dealt(visitors), (homes.anchor == visitors.anchor) & close).select("a", "b")


def simhash_components(
    docs: DataFrame, shingle: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links of fingerprints."""
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    labels = components(near_links(nodes.select("fp"), threshold))
    marked = nodes.join(dealt(labels), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    least = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    named = marked.join(least, "label").select(F.col("fp").alias("c_fp"), "component_id")
    return prints.join(dealt(named), F.col("fp") == F.col("c_fp")).select(id_col, "fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex and component_id per document."""
    found = simhash_components(docs)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")
