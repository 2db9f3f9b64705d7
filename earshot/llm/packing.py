"""Packing documents into sequences by cutting-stock column generation.

Every text becomes token ids and an end id. What fills whole sequences is cut off each
document; the tails, shorter than a sequence, are items of a cutting-stock problem
(``cutting_stock``). Its plan depends on the histogram of tail lengths alone and says
for each length which ranks of tails go to which sequences. Tails are ranked within
their length by task and order in the task, so the plan is applied without a sort.

The tasks that encode texts number full pieces and tails of each length by themselves
and write ids and numbers down once; sums over tasks give each task its first ranks.
These sums, a row for each task, come to the rows as a broadcast while they are few
(``FEW_STARTS``), and by a join on the task beyond that.

Texts are encoded by the fast library for the same vocabulary wherever its pattern and
the tokenizer's must agree on every character: letters, digits and blanks whose class
has not changed since Unicode 3.2. Other texts, and those with very long runs without a
blank, go through the tokenizer itself.

Defined results: a null or empty text is the end id alone; special strings inside a
text are one token each, as the library reads them; every row is packed, so repeated
rows and ties each have their own pieces; a null id is kept; an empty table gives an
empty result; very long texts fill many sequences; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import pick, stored
from .cutting_stock import packing_plan

FEW_STARTS = 512  # tasks whose first ranks are broadcast: at most 1024 numbers each
LONGEST_RUN = 2000  # characters without a blank, or of blanks, that the fast library may get
# Fixed value: the pattern by which byte-level vocabularies split texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(spec: str) -> dict[bytes, int]:
    """Bytes and id of each ordinary token of a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    described = json.loads(spec)
    special = {t["content"] for t in described["added_tokens"]}
    return {bytes(map(back.__getitem__, t)): i for t, i in described["model"]["vocab"].items() if t not in special}


class Encoder:
    """Ids of texts as the tokenizer gives them without added special tokens."""

    def __init__(self, spec: str, ranks: list[tuple[str, int]]):
        self.tokenizer = Tokenizer.from_str(spec)
        specials = {t["content"]: t["id"] for t in json.loads(spec)["added_tokens"]}
        coded = {base64.b64decode(b): i for b, i in ranks}
        self.fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=coded, special_tokens=specials)
        self.sure: set[str] = set(map(chr, range(128)))
        self.unsure: set[str] = set()
        self.long = re.compile(rf"\S{{{LONGEST_RUN}}}|\s{{{LONGEST_RUN}}}")

    @staticmethod
    def settled(char: str) -> bool:
        """Is the character of one class in old and new tables of Unicode?"""
        old, new = unicodedata.ucd_3_2_0.category(char), unicodedata.category(char)
        return old != "Cn" and old[0] == new[0] and old[0] != "Z" and old != "Cc"

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        fast = len(text) < LONGEST_RUN or not self.long.search(text)
        if fast and not text.isascii():
            for char in set(text) - self.sure - self.unsure:
                (self.sure if self.settled(char) else self.unsure).add(char)
            fast = not self.unsure or self.unsure.isdisjoint(text)
        if fast:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


ENCODED = T.StructType(
    [
        T.StructField("ids", T.BinaryType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("first_full", T.LongType()),
        T.StructField("rank", T.LongType()),
    ]
)
PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
)


def encoded(rows: DataFrame, vocabulary: str, end_id: int, width: int) -> DataFrame:
    """``rows`` (p_id, p_text) as (p_id, ids, tokens, task, first_full, rank), written once.

    ``ids`` are little-endian 32-bit numbers, the end id last. ``first_full`` counts the
    full pieces before the row's in its task, ``rank`` the tails of the same length.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    ranks = [(base64.b64encode(b).decode(), i) for b, i in byte_ranks(spec).items()]
    sent = rows.sparkSession.sparkContext.broadcast((spec, ranks))

    @F.pandas_udf(ENCODED)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(*sent.value)
        task = TaskContext.get().partitionId()
        fulls, tails = 0, [0] * width
        end = np.array([end_id], "<u4").tobytes()
        for texts in batches:
            out = []
            for text in texts:
                ids = encoder.of(text).astype("<u4", copy=False).tobytes() + end
                tokens = len(ids) // 4
                full, tail = divmod(tokens, width)
                out.append((ids, tokens, task, fulls, tails[tail]))
                fulls += full
                tails[tail] += 1
            yield pd.DataFrame(out, columns=ENCODED.names)

    return stored(rows.select("p_id", encode("p_text").alias("e")).select("p_id", "e.*"), "encoded")


def first_ranks(rows: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(task, starts: tail -> first rank) of each task, starts[0] for full pieces; and all tails by length.

    The histogram, at most ``width`` numbers, reaches the driver.
    """
    tail, full = F.col("tokens") % width, F.floor(F.col("tokens") / width)
    tails = rows.where(tail > 0).groupBy("task", tail.cast("int").alias("tail")).agg(F.count("*").alias("n"))
    fulls = rows.groupBy("task").agg(F.sum(full).alias("n")).select("task", F.lit(0).alias("tail"), "n")
    counts = stored(tails.union(fulls), "tails")
    histogram = np.zeros(width, np.int64)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        histogram[r.tail] = r.n if r.tail else 0
    before = F.sum("n").over(Window.partitionBy("tail").orderBy("task")) - F.col("n")
    starts = counts.select("task", "tail", before.alias("before")).groupBy("task")
    starts = starts.agg(F.map_from_entries(F.collect_list(F.struct("tail", "before"))).alias("starts"))
    return stored(starts, "starts"), histogram


def pack_documents(
    docs: DataFrame, vocabulary: str, width: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all rows.

    ``ids`` holds the piece's token ids as little-endian 32-bit numbers. Sequences are
    full or, for the last few of them, of a power of two of tokens; they are numbered
    from 0, patterns first, then the stream, then the full pieces of long documents.
    """
    rows = encoded(pick(docs, id_col, text_col).toDF("p_id", "p_text"), vocabulary, end_id, width)
    starts, histogram = first_ranks(rows, width)
    plan = rows.sparkSession.sparkContext.broadcast(packing_plan(histogram, width))
    few = starts.limit(FEW_STARTS + 1).count() <= FEW_STARTS
    starts = starts.withColumnsRenamed({"task": "s_task"})
    placed = rows.join(F.broadcast(starts) if few else starts, F.col("task") == F.col("s_task"))
    tail = (F.col("tokens") % width).cast("int")
    placed = placed.select(
        "p_id",
        "ids",
        "tokens",
        (F.col("first_full") + F.element_at("starts", F.lit(0))).alias("full"),
        F.when(tail > 0, F.col("rank") + F.element_at("starts", tail)).otherwise(0).alias("rank"),
    )

    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        dealt = plan.value
        for columns in batches:
            out = []
            for ids, tokens, full, rank in zip(*columns, strict=True):
                whole, tail = divmod(tokens, width)
                pieces = [(k * width, width, dealt.sequences + full + k, 0) for k in range(whole)]
                if tail:
                    pieces += [(whole * width + a, n, s, o) for a, n, s, o in dealt.pieces(tail, rank)]
                out.append([(a, n, ids[4 * a : 4 * (a + n)], s, o) for a, n, s, o in pieces])
            yield pd.Series(out)

    told = placed.select("p_id", "tokens", F.explode(cut("ids", "tokens", "full", "rank")).alias("p"))
    return told.select(
        F.col("p_id").alias(id_col), "p.start", "p.length", "p.ids", F.col("tokens").alias("doc_tokens"), "p.sequence_id", "p.offset"
    )


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, each of at most as many pieces as it has tokens."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(inside, F.lit(b"").cast("binary"), lambda so_far, piece: F.concat(so_far, piece["ids"]))
    return pieces.groupBy("sequence_id").agg(whole.alias("ids"))


def packing_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Where each piece stands and the checksum of its ids."""
    pieces = pack_documents(docs, vocabulary)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
