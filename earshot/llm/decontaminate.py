"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found with k = rate * m edits. Cut in k + 1
pieces, one piece at least stands unchanged wherever the item is found: exact
piece hits give windows of the text, and Myers' bit-parallel distance decides on
each. Texts and items are compared lower-cased with runs of white space as one
space.

Items go to the tasks in blocks of about ``BLOCK_BYTES`` of text. Documents are
searched for one block after the other, what is found being written in between, so
neither the driver nor a task ever holds more than a block; a benchmark of one block,
the usual size, takes a single pass. Hits are found per document, without a shuffle.

Defined results: null or empty texts hold no item; null or empty items are never
found; items of fewer than ``shortest`` characters, short enough for chance to matter,
are found where they stand as whole words, with the edits that the rate gives them;
repeated rows and null ids are searched row by row; an item id that stands twice,
or a null one, is found item by item; an empty table on either side gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, stored

RATE = 0.07  # edits per character of an item
SHORTEST = 20
BLOCK_BYTES = 2 << 20


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits`` + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def least_distance(item_masks: dict[str, int], m: int, text: str) -> int:
    """Fewest edits from the item to any substring of ``text`` (Myers, bit-parallel)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    get = item_masks.get
    for c in text:
        eq = get(c, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        lower = plus & across
        if up & top:
            score += 1
        elif lower & top:
            score -= 1
            if score < best:
                best = score
        up = up << 1 & full
        plus = (lower << 1 & full) | (full & ~(down | up))
        minus = up & down
    return best


def whole_distance(item_masks: dict[str, int], m: int, text: str) -> int:
    """Edits from the item to all of ``text`` (Myers, bit-parallel)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in text:
        eq = item_masks.get(c, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        lower = plus & across
        score += 1 if up & top else -1 if lower & top else 0
        up = (up << 1 | 1) & full
        plus = (lower << 1 & full) | (full & ~(down | up))
        minus = up & down
    return score


class Matcher:
    """All items of a block: the automaton over their pieces, and the verifier."""

    def __init__(self, items: Sequence[tuple], rate: float, shortest: int):
        self.items = []
        words: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = plain(text)
            if not text:
                continue
            edits = math.floor(rate * len(text))
            bound = len(text) < shortest  # stands as whole words
            if bound and not edits:
                text = f" {text} "
            for offset, piece in pieces(text, edits):
                words.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, edits, masks(text), bound and edits > 0))
        self.automaton = ahocorasick.Automaton()
        for word, places in words.items():
            self.automaton.add_word(word, (len(word), places))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item id, fewest edits) of each item that stands in the text."""
        text = plain(text)
        if not text or not self.items:
            return []
        text = f" {text} "
        found = []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                starts.setdefault(k, set()).add(end + 1 - size - offset)
        for k, diagonals in starts.items():
            item_id, item, edits, item_masks, bound = self.items[k]
            best = edits + 1
            if bound:
                best = min((self.between_words(item, item_masks, edits, text, d) for d in diagonals), default=best)
                diagonals = ()
            for window in self.windows(sorted(diagonals), len(item), edits):
                part = text[max(0, window[0]) : window[1]]
                best = 0 if item in part else min(best, least_distance(item_masks, len(item), part))
                if best == 0:
                    break
            if best <= edits:
                found.append((item_id, best))
        return found

    @staticmethod
    def between_words(item: str, item_masks: dict[str, int], edits: int, text: str, start: int) -> int:
        """Fewest edits from the item to whole words of the text that begin about ``start``; more than ``edits`` if none are near."""
        best = edits + 1
        for a in range(max(1, start - edits), start + edits + 1):
            if text[a - 1 : a] != " ":
                continue
            for b in range(a + len(item) - edits, min(a + len(item) + edits, len(text) - 1) + 1):
                if text[b : b + 1] == " ":
                    best = min(best, whole_distance(item_masks, len(item), text[a:b]))
        return best

    @staticmethod
    def windows(diagonals: list[int], m: int, edits: int) -> Iterator[tuple[int, int]]:
        """Joined stretches of text around the given starts of an item."""
        first = last = None
        for d in diagonals:
            a, b = d - edits, d + m + edits
            if first is None:
                first, last = a, b
            elif a <= last:
                last = max(last, b)
            else:
                yield first, last
                first, last = a, b
        if first is not None:
            yield first, last


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The items (b_id, b_text) in blocks of about ``BLOCK_BYTES``."""
    rows = pick(benchmark, item_col, text_col).toDF("b_id", "b_text").where("b_text is not null")
    size = rows.agg(F.sum(F.octet_length("b_text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("b_id", "b_text"), F.lit(blocks))
    return [rows.where(block == b) for b in range(blocks)]


def _hits_type(item_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item", item_type), T.StructField("distance", T.LongType())]))


def _matcher(block: DataFrame, rate: float, shortest: int):
    """The broadcast items of a block, and a vectorised function text -> hits."""
    items = sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    sent = block.sparkSession.sparkContext.broadcast(items)

    @F.pandas_udf(_hits_type(block.schema["b_id"].dataType))
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate, shortest)
        for texts in batches:
            rows = [matcher.find(t) for t in texts]
            yield pd.Series([[{"item": i, "distance": d} for i, d in r] for r in rows])

    return sent, match


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    shortest: int = SHORTEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """(id, item, distance) of every item found in every row."""
    rows = pick(docs, id_col, text_col).toDF("t_id", "t_text")
    blocks = _blocks(benchmark, item_col, text_col)
    found = []
    for block in blocks:
        sent, match = _matcher(block, rate, shortest)
        hits = rows.select("t_id", F.explode(match("t_text")).alias("hit"))
        if len(blocks) > 1:
            hits = stored(hits, "hits")
            sent.destroy()
        found.append(hits)
    hits = reduce(DataFrame.union, found)
    return hits.select(F.col("t_id").alias(id_col), F.col("hit.item").alias(item_col), F.col("hit.distance").alias("distance"))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, shortest: int = SHORTEST, text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    text = places[docs.columns.index(text_col)]
    left = docs.toDF(*places)
    blocks = _blocks(benchmark, item_col, "text")
    for block in blocks:
        sent, match = _matcher(block, rate, shortest)
        left = left.where(F.size(match(text)) == 0)
        if len(blocks) > 1:
            left = stored(left, "free")
            sent.destroy()
    return left.toDF(*docs.columns)
