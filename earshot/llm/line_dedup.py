"""Line dedup with two Bloom filters.

Each line key is known by a 128-bit hash. A task gives the hashes of its rows' keys
once each; those it sees in two rows itself are suspected at once. The hashes, and
not the lines, are dealt over segments, and each segment sets
for each hash it gets the bits of a filter of keys seen once and, where those are
set already, of a filter of keys seen twice. Only keys that the second filter holds,
the suspected repeats, are shuffled by key, counted exactly by their whole hash, and
taken out of all documents but the one with the largest id.

The number of segments grows with the number of hashes, so filters keep their size
and their rate of false suspicions whatever the corpus, and nothing of them reaches
the driver. A very frequent line comes to its segment once a task.

Rows are known by two hashes of id and text, so ids of any type stay in Spark.

Defined results: a null or empty text is one empty line; every row is a document,
so a repeated row counts again, and rows sharing the largest id all keep the line;
a null id is smaller than any other; an empty table gives an empty result; very
long texts are processed whole; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, pick, stored

SEGMENT_KEYS = 1 << 18  # hashes of a segment, about
FILTER_BITS = 1 << 23  # of each filter of a segment: 1 MB
TASK_KEYS = 1 << 20  # hashes a task holds before it gives them on
SEED = 7
SINGLE, SUSPECT, REPEAT = 0, 1, 2  # of a task's hash: seen in one row; in more, the first of them; the others


def line_key(line: str) -> str:
    """The line without blanks at its ends, A-Z lower-cased."""
    key = line.strip(BLANKS)
    return key.lower() if key.isascii() else key.encode().lower().decode()


def line_keys(text: str | None, shortest: int) -> set[str]:
    keys = map(line_key, (text or "").split("\n"))
    return {k for k in keys if len(k) >= shortest}


def key_digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode(), SEED)


def key_hash(key: str) -> tuple[int, int]:
    return struct.unpack("<2q", key_digest(key))


class Bits:
    """A Bloom filter with two bits per hash."""

    def __init__(self) -> None:
        self.array = np.zeros(FILTER_BITS >> 3, np.uint8)

    @staticmethod
    def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.int64(FILTER_BITS - 1)
        return hashes & mask, (hashes >> 24) & mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        first, second = self.places(hashes)
        at = lambda p: (self.array[p >> 3] >> (p & 7).astype(np.uint8)) & 1
        return (at(first) & at(second)).astype(bool)

    def add(self, hashes: np.ndarray) -> None:
        for place in self.places(hashes):
            np.bitwise_or.at(self.array, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))


HASHES = "m1 long, m2 long, h1 long, h2 long, kind int"


def _task_hashes(shortest: int):
    """(mark, hash, kind) of every key of every row; kinds tell what a task itself sees."""

    def settled(marks: list[tuple[int, int]], owners: list[np.ndarray], digests: list[bytes]) -> pd.DataFrame:
        owner = np.concatenate(owners)
        own = np.array(marks, np.int64)[owner]
        hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        own, hashes = own[order], hashes[order]
        same = (hashes[1:] == hashes[:-1]).all(1)
        after, before = np.concatenate(([False], same)), np.concatenate((same, [False]))
        kind = np.where(after, REPEAT, np.where(before, SUSPECT, SINGLE))
        return pd.DataFrame({"m1": own[:, 0], "m2": own[:, 1], "h1": hashes[:, 0], "h2": hashes[:, 1], "kind": kind})

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks: list[tuple[int, int]] = []
        owners: list[np.ndarray] = []
        digests: list[bytes] = []
        for batch in batches:
            for m1, m2, text in zip(batch["m1"], batch["m2"], batch["d_text"], strict=True):
                found = [key_digest(k) for k in line_keys(text, shortest)]
                if found:
                    owners.append(np.full(len(found), len(marks)))
                    marks.append((m1, m2))
                    digests += found
                if len(digests) >= TASK_KEYS:
                    yield settled(marks, owners, digests)
                    marks, owners, digests = [], [], []
        if digests:
            yield settled(marks, owners, digests)

    return give


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one segment's hashes, those that its filter of keys seen twice holds."""
    once, twice = Bits(), Bits()
    held = list(batches)
    for batch in held:
        hashes = batch["h1"].to_numpy(np.int64)
        unique, counts = np.unique(hashes, return_counts=True)
        twice.add(unique[(counts > 1) | once.has(unique)])
        twice.add(hashes[batch["kind"].to_numpy() == SUSPECT])
        once.add(unique)
    for batch in held:
        yield batch[twice.has(batch["h1"].to_numpy(np.int64)) & (batch["kind"] == SINGLE)].drop(columns="kind")


def suspected(rows: DataFrame, shortest: int) -> DataFrame:
    """(m1, m2, h1, h2) of the keys of ``rows`` (m1, m2, d_text) that may stand in two rows."""
    hashes = stored(rows.select("m1", "m2", "d_text").mapInPandas(_task_hashes(shortest), HASHES), "hashes")
    routed = hashes.where(F.col("kind") < REPEAT)
    segments = max(1, math.ceil(routed.count() / SEGMENT_KEYS))
    single = routed.repartition(segments, "h2").mapInPandas(_suspects, "m1 long, m2 long, h1 long, h2 long")
    return single.union(hashes.where(F.col("kind") > SINGLE).select("m1", "m2", "h1", "h2"))


KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


def _without(shortest: int):
    @F.pandas_udf(KEPT)
    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, drops, strict=True):
            lines = (text or "").split("\n")
            if drop is None:
                out.append((len(lines), 0, None))
                continue
            gone = {(d["h1"], d["h2"]) for d in drop}
            keys = [line_key(x) for x in lines]
            kept = [x for x, k in zip(lines, keys, strict=True) if len(k) < shortest or key_hash(k) not in gone]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    return without


def dedup_lines(
    docs: DataFrame, shortest: int = 20, documents: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row.

    Lines whose key has at least ``shortest`` code points and stands in at least
    ``documents`` rows stay only where the id is largest.
    """
    rows = pick(docs, id_col, text_col).toDF("d_id", "d_text")
    rows = rows.withColumns({"m1": F.xxhash64("d_id", "d_text"), "m2": F.xxhash64(F.lit(SEED), "d_text", "d_id")})
    suspects = stored(suspected(rows, shortest), "suspects")
    ids = rows.select("m1", "m2", "d_id").join(suspects.select("m1", "m2").distinct(), ["m1", "m2"], "left_semi").distinct()
    named = stored(suspects.join(ids, ["m1", "m2"]), "named")
    repeats = named.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("d_id").alias("keeper"))
    repeats = stored(repeats.where(F.col("n") >= documents).select("h1", "h2", "keeper"), "repeats")
    drops = (
        named.join(repeats, ["h1", "h2"])
        .where(~F.col("d_id").eqNullSafe(F.col("keeper")))
        .groupBy("m1", "m2")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    )
    told = rows.join(stored(drops, "drops"), ["m1", "m2"], "left").withColumn("told", _without(shortest)("d_text", "drops"))
    return told.select(
        F.col("d_id").alias(id_col),
        "told.n_lines",
        "told.n_dropped",
        F.coalesce("told.kept", "d_text", F.lit("")).alias("kept"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """Line counts and the digest of what is kept, per document."""
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# Lines are cut and keyed as above; translate and trim spell the same rule.
LINE_SQL = r"""
with numbered as (
  select row_number() over () as n_row, doc_id, text from documents
), lines as (
  select n_row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
  from numbered
), keyed as (
  select n_row, doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), repeats as (
  select key, max(doc_id) as keeper from keyed
  where length(key) >= 20 group by key having count(distinct n_row) >= 3
), judged as (
  select k.n_row, k.doc_id, k.n, k.line, r.key is not null and k.doc_id is distinct from r.keeper as gone
  from keyed k left join repeats r on k.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from judged group by n_row, doc_id
"""
