"""Ranked lexical search with Block-Max MaxScore over an inverted index in shards.

``build_index`` writes, for each shard of documents and each term in it, a posting list:
blocks of ``BLOCK`` compressed postings, and beside them, readable without decompression,
the last document of each block and the best (occurrences, document length) pairs in it,
from which a bound on any score in the block follows. ``search`` looks up the lists of a
block of queries, and every shard answers every query by itself:

* lists are sorted by their bound; those whose bounds together cannot lift a document
  over the k-th score so far are non-essential, and only documents in the others are
  candidates;
* the candidates of a window of documents meet the non-essential lists in falling order
  of bound; a candidate that the bound of its block there cannot lift over the k-th score
  is rejected before that block is decompressed;
* the k best of each shard are merged, at most k rows a query and shard.

Scores are whole numbers: a term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))) and
each occurrence count is damped by the document's length, see ``damped``. Terms are
maximal runs of letters, digits and all characters beyond ASCII, A-Z lower-cased.

An index does not depend on the queries, nor on N or the documents' mean length. A shard
holds about ``SHARD_POSTINGS`` postings, whatever the size of the corpus. Queries are
taken in blocks of about ``QUERY_BLOCK``; only their terms and those terms' numbers of
documents reach the driver.

Defined results: a null or empty text has no terms, and is no answer; a null document id
comes last among equal scores; repeated rows are documents of their own; repeated queries
(same id and text) are one, queries that share an id only are two; a query without terms
has no answer; empty tables give an empty result; very long texts are indexed whole; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

BLOCK = 128  # postings of a block
SHARD_POSTINGS = 1 << 21
SHARD_DOCUMENTS = 1 << 16
QUERY_BLOCK = 4096
WINDOWS = (256, 8192)  # documents of the first and of the largest window
# Fixed value: what a term is.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASSES = ((1, 1), (2, 2), (3, 4), (5, 1 << 31))  # counts whose shortest documents a block remembers


def terms_of(text: str | None) -> list[str]:
    if not text:
        return []
    return TERM.findall(text.lower() if text.isascii() else text.encode().lower().decode())


# Postings


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, seven bits a byte, and where each number ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28, 35):
        sizes += values >= np.uint64(1) << np.uint64(bits)
    ends = sizes.cumsum()
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(6):
        has = np.flatnonzero(sizes > k)
        if not len(has):
            break
        low = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[ends[has] - sizes[has] + k] = low + np.where(sizes[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, ends


def numbers(data: bytes) -> np.ndarray:
    """What ``varints`` wrote."""
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    first = np.flatnonzero(np.concatenate(([True], last[:-1])))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


INDEX = "shard string, term string, n_documents long, n_terms long, ends binary, sizes binary, tops binary, data binary"


class Shard:
    """Documents gathered until they are enough for a shard."""

    def __init__(self) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.missing: list[bool] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int, missing: bool, text: str | None) -> None:
        found = terms_of(text)
        if not found:
            return
        counted = Counter(found)
        numbered = self.vocabulary
        self.terms.append(np.fromiter((numbered.setdefault(t, len(numbered)) for t in counted), np.int64, len(counted)))
        self.counts.append(np.fromiter(counted.values(), np.int64, len(counted)))
        self.ids.append(doc_id)
        self.missing.append(missing)
        self.lengths.append(len(found))
        self.postings += len(counted)

    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCUMENTS

    def rows(self, name: str) -> Iterator[tuple]:
        """One row a term, and a first one without term that has the documents' ids and lengths."""
        ids, missing = np.array(self.ids, np.int64), np.array(self.missing, bool)
        order = np.lexsort((ids, missing))  # places follow the ids, so equal scores come in order of place
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)
        yield (name, None, len(ids), int(lengths.sum()), missing[order].tobytes(), lengths[order].tobytes(), b"", ids[order].tobytes())
        term = np.concatenate(self.terms)
        at = np.repeat(place, [len(t) for t in self.terms])
        count = np.concatenate(self.counts)
        sort = np.lexsort((at, term))
        term, at, count = term[sort], at[sort], count[sort]
        length = lengths[order][at]
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        sizes = np.diff(np.append(starts, len(term)))
        inside = np.arange(len(term)) - np.repeat(starts, sizes)
        blocks = np.flatnonzero(inside % BLOCK == 0)
        first = inside == 0
        before = np.concatenate(([0], at[:-1]))
        deltas = np.where(first, at + 1, at - before)  # of the document before, in other blocks too
        data, ends = varints(np.column_stack((deltas, count)).ravel())
        last = np.append(blocks[1:], len(term)) - 1
        tops = np.zeros((len(blocks), len(CLASSES), 2), "<i4")
        for k, (low, high) in enumerate(CLASSES):
            has = (count >= low) & (count <= high)
            tops[:, k, 0] = np.maximum.reduceat(np.where(has, count, 0), blocks)
            shortest = np.minimum.reduceat(np.where(has, length, 1 << 31 - 1), blocks)
            tops[:, k, 1] = np.where(tops[:, k, 0] > 0, shortest, 0)
        byte_end = ends[2 * last + 1]
        last_place = at[last].astype("<i4")
        of_term = np.searchsorted(blocks, np.append(starts, len(term)))
        names = list(self.vocabulary)
        begin = 0
        for k, t in enumerate(term[starts]):
            a, b = of_term[k], of_term[k + 1]
            end = int(byte_end[b - 1])
            yield (
                name,
                names[t],
                int(sizes[k]),
                None,
                last_place[a:b].tobytes(),
                (byte_end[a:b] - begin).astype("<i4").tobytes(),
                tops[a:b].tobytes(),
                data[begin:end].tobytes(),
            )
            begin = end


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task, made, shard = TaskContext.get().partitionId(), 0, Shard()

    def frames() -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for row in shard.rows(f"{task}-{made}"):
            rows.append(row)
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)

    names = [part.split()[0] for part in INDEX.split(", ")]
    for batch in batches:
        for doc_id, missing, text in zip(batch["r_id"], batch["r_missing"], batch["r_text"], strict=True):
            shard.add(doc_id, missing, text)
            if shard.full():
                yield from frames()
                made, shard = made + 1, Shard()
    if shard.ids:
        yield from frames()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The posting lists of all rows, written once; one pass over the texts, without a shuffle.

    Ids are whole numbers. A shard is what a task has read, or a part of it.
    """
    rows = pick(docs, id_col, text_col).toDF("r_id", "r_text")
    rows = rows.select(
        F.coalesce(F.col("r_id").cast("long"), F.lit(0)).alias("r_id"), F.col("r_id").isNull().alias("r_missing"), "r_text"
    )
    return stored(rows.mapInPandas(_indexed, INDEX), "index")


# Scores


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def masses(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The damping of documents by their length: 10, and 90 times the length over the mean length."""
    if len(lengths) and int(lengths.max()) * 90 * documents >= 1 << 63:
        return np.array([10 + 90 * int(n) * documents // terms for n in lengths], np.int64)
    return 10 + 90 * lengths.astype(np.int64) * documents // terms


def damped(counts: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 8 m)."""
    return 1_000_000_000 * counts // (1000 * counts + 8 * mass)


class Postings:
    """One term's list in one shard."""

    def __init__(self, row, term_weight: int, mass_of) -> None:
        self.weight = term_weight
        self.last = np.frombuffer(row.ends, "<i4").astype(np.int64)
        self.sizes = np.frombuffer(row.sizes, "<i4")
        self.data = row.data
        tops = np.frombuffer(row.tops, "<i4").reshape(-1, len(CLASSES), 2).astype(np.int64)
        counts = tops[:, :, 0]
        scores = np.where(counts > 0, damped(np.maximum(counts, 1), mass_of(tops[:, :, 1])), 0)
        self.bounds = term_weight * scores.max(1)
        self.bound = int(self.bounds.max())

    def decoded(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the blocks from ``first`` to before ``end``."""
        begin = int(self.sizes[first - 1]) if first else 0
        values = numbers(self.data[begin : int(self.sizes[end - 1])])
        base = int(self.last[first - 1]) if first else -1
        return base + values[::2].cumsum(), values[1::2]


def best_of_shard(lists: Sequence[Postings], mass: np.ndarray, k: int, tell: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents above 0, best first, equal scores by place.

    ``tell`` counts blocks that were decompressed and candidates that were rejected unseen.
    """
    lists = sorted((p for p in lists if p.bound > 0), key=lambda p: p.bound)
    together = np.cumsum([p.bound for p in lists])
    top_places, top_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    limit, low, width = 0, 0, WINDOWS[0]
    tell = {} if tell is None else tell
    while low < len(mass):
        high = min(low + width, len(mass))
        plain = int(np.searchsorted(together, limit, side="right"))  # lists that are not essential
        if plain == len(lists):
            break
        score = np.zeros(high - low, np.int64)
        for p in lists[plain:]:
            first, end = int(np.searchsorted(p.last, low)), int(np.searchsorted(p.last, high - 1)) + 1
            end = min(end, len(p.last))
            if first < end:
                at, counts = p.decoded(first, end)
                tell["blocks"] = tell.get("blocks", 0) + end - first
                a, b = np.searchsorted(at, (low, high))
                score[at[a:b] - low] += p.weight * damped(counts[a:b], mass[at[a:b]])
        found = np.flatnonzero(score)
        if plain:
            found = found[score[found] + together[plain - 1] > limit]
        for j in range(plain - 1, -1, -1):
            if not len(found):
                break
            p, rest = lists[j], int(together[j - 1]) if j else 0
            block = np.searchsorted(p.last, found + low)
            there = block < len(p.last)
            bound = np.where(there, p.bounds[np.minimum(block, len(p.last) - 1)], 0)
            hopeful = score[found] + bound + rest > limit
            tell["rejected"] = tell.get("rejected", 0) + int((~hopeful).sum())
            found, block, there = found[hopeful], block[hopeful], there[hopeful]
            asked = np.unique(block[there])
            tell["blocks"] = tell.get("blocks", 0) + len(asked)
            for b in asked:
                at, counts = p.decoded(int(b), int(b) + 1)
                mine = found[block == b]
                spot = np.minimum(np.searchsorted(at, mine + low), len(at) - 1)
                hit = at[spot] == mine + low
                score[mine[hit]] += p.weight * damped(counts[spot[hit]], mass[mine[hit] + low])
            found = found[score[found] + rest > limit]
        found = found[score[found] > limit]
        if len(found):
            top_places, top_scores = np.concatenate((top_places, found + low)), np.concatenate((top_scores, score[found]))
            order = np.lexsort((top_places, -top_scores))[:k]
            top_places, top_scores = top_places[order], top_scores[order]
            if len(order) == k:
                limit = int(top_scores[-1])
        low, width = high, min(2 * width, WINDOWS[1])
    return top_places, top_scores


FOUND = "r_key string, doc_id long, missing boolean, score long"


def _answers(queries, k: int):
    """The k best documents of a shard for each query of a broadcast block."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        block, weights, documents, terms = queries.value
        head = rows[rows["term"].isna()].iloc[0]
        ids, missing = np.frombuffer(head["data"], np.int64), np.frombuffer(head["ends"], bool)
        mass = masses(np.frombuffer(head["sizes"], np.int64), documents, terms)
        mass_of = lambda n: masses(n.ravel(), documents, terms).reshape(n.shape)
        lists = {r.term: Postings(r, weights[r.term], mass_of) for r in rows[rows["term"].notna()].itertuples(index=False)}
        out = []
        for key, asked in block:
            places, scores = best_of_shard([lists[t] for t in asked if t in lists], mass, k)
            out += [(key, int(ids[p]), bool(missing[p]), int(s)) for p, s in zip(places, scores, strict=True)]
        return pd.DataFrame(out, columns=["r_key", "doc_id", "missing", "score"])

    return answer


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(query id, rank, doc_id, score): the k best documents above 0 of each query, equal scores by id."""
    spark = index.sparkSession
    asked = pick(queries, id_col, text_col).toDF("r_id", "r_text").distinct()
    asked = stored(asked.withColumn("r_key", F.sha2(F.to_json(F.struct("r_id", "r_text")), 256)), "queries")
    total = index.where("term is null").agg(F.sum("n_documents").alias("n"), F.sum("n_terms").alias("l")).first()
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    found = spark.createDataFrame([], FOUND)
    for number in range(blocks if total.n else 0):
        part = asked.where(F.pmod(F.xxhash64("r_key"), F.lit(blocks)) == number).select("r_key", "r_text")
        block = [(r.r_key, list(dict.fromkeys(terms_of(r.r_text)))) for r in part.collect()]
        words = spark.createDataFrame([(t,) for t in sorted({t for _, ts in block for t in ts})], "term string")
        lists = index.join(F.broadcast(words), "term", "left_semi")  # the terms of a block of queries
        holding = {r.term: r.n for r in lists.groupBy("term").agg(F.sum("n_documents").alias("n")).collect()}
        weights = {t: weight(total.n, n) for t, n in holding.items()}
        sent = spark.sparkContext.broadcast((block, weights, total.n, total.l))
        rows = lists.select(*index.columns).union(index.where("term is null"))
        best = rows.groupBy("shard").applyInPandas(_answers(sent, k), FOUND)
        found = found.union(stored(best, "found") if blocks > 1 else best)
    order = Window.partitionBy("r_key").orderBy(F.desc("score"), "missing", "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    told = ranked.join(asked.select("r_key", "r_id"), "r_key")
    return told.select(
        F.col("r_id").alias(id_col), F.col("rank").cast("int").alias("rank"), F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "score"
    )


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item, through an index of all documents."""
    return search(build_index(docs), items, k)


# Scores of all documents of each item, of which the ten highest are kept.
SEARCH_SQL = r"""
with terms as (
  select n_row, doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as n_row, doc_id, text from documents)
), counts as (
  select n_row, doc_id, term, count(*) as tf from terms group by n_row, doc_id, term
), sizes as (
  select n_row, cast(sum(tf) as bigint) as n from counts group by n_row
), total as (
  select cast(count(*) as bigint) as big_n, cast(sum(n) as bigint) as big_l from sizes
), weights as (
  select term, cast(floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
  from counts, total group by term, big_n
), asked as (
  select distinct item_id, text, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), scores as (
  select item_id, text, c.n_row, doc_id,
         cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) as bigint) as score
  from asked join counts c using (term) join weights using (term) join sizes s on s.n_row = c.n_row, total
  group by item_id, text, c.n_row, doc_id
)
select item_id, cast(row_number() over (partition by item_id, text order by score desc, doc_id) as integer) as rank, doc_id, score
from scores where score > 0
qualify row_number() over (partition by item_id, text order by score desc, doc_id) <= 10
"""
