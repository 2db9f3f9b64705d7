"""Spelling variants of a vocabulary through a variable-length gram index.

Two words are near if one inserted, deleted or replaced code point makes them equal. Pairs
are found, and none is lost, without comparing words one by one:

* *gram dictionary*: grams of 2 to 5 symbols of the words, each between marks for its start
  and end. A gram is lengthened by one symbol only where its shorter form is frequent, so
  long grams exist only where short ones would have long lists;
* *decomposition*: from each place of a word starts one gram, the shortest that is not
  frequent. It depends on its own symbols alone, so an edit touches only grams that cover
  its place;
* *bound*: the most grams of a word that one edit can touch. A near word holds all its
  other grams, one place further at most. With grams of at most 5 symbols a word of 5 code
  points keeps at least one;
* *list merging*: in an order of all grams, rare ones first, a word and a near word share
  a gram among the first (bound + 1) of each. Only these are indexed, by gram, place and
  word length, and lists of words that may be near meet by a join;
* *verification*: the edit distance of each meeting pair is computed.

The dictionary holds grams of more than ``1 / GRAMS`` of all places only; it has at most
``4 x GRAMS`` entries whatever the vocabulary, and is what reaches the driver and tasks.
Words never do.

A word's form is its near word of largest count, if that is at least twice its own; from
form to form counts at least double, so chains are short, and roots are found by jumping.

Defined results: a null or empty text has no words; a null id is written as an empty text
in the hash that spoils runs; repeated rows count again; words are compared whole, however
long; equal counts are settled by code points; a table without words gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SPOILED = 97  # of so many runs about one loses a code point
SHORTEST, LONGEST = 2, 5  # symbols of a gram
GRAMS = 64_000
FREQUENT = 4  # a gram is lengthened if it is so many times as frequent as the rarest of the dictionary
TASK_WORDS = 500_000  # words or grams a task counts before it gives them on
LONG_WORD = 64  # code points from which on the index holds a word's digest


# Words


def spoiled(prefix: int, run: str) -> str:
    """The run, or without one code point where the hash of id and run says so; ``prefix`` is that of the id."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SPOILED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        frame = lambda: pd.DataFrame({"word": list(held), "n": list(held.values())})
        for batch in batches:
            for name, text in zip(batch["v_id"], batch["v_text"], strict=True):
                lower = text.lower() if text.isascii() else text.encode().lower().decode()
                prefix = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(RUN.findall(lower)).items():
                    word = spoiled(prefix, run)
                    if len(word) >= least:
                        held[word] = held.get(word, 0) + n
                if len(held) >= TASK_WORDS:
                    yield frame()
                    held.clear()
        if held:
            yield frame()

    return count


def vocabulary(docs: DataFrame, shortest: int = 5, occurrences: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts, long and frequent enough, written once."""
    rows = pick(docs, id_col, text_col).toDF("v_id", "v_text").where("v_text is not null")
    rows = rows.select(F.coalesce(F.col("v_id").cast("string"), F.lit("")).alias("v_id"), "v_text")
    counts = rows.mapInPandas(_counted(shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= occurrences), "vocabulary")


# Grams


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, int] = {}
    frame = lambda: pd.DataFrame({"gram": list(held), "n": list(held.values())})
    for batch in batches:
        for word in batch["word"]:
            marked = f"^{word}$"
            for size in range(SHORTEST, LONGEST + 1):
                for at in range(len(marked) - size + 1):
                    gram = marked[at : at + size]
                    held[gram] = held.get(gram, 0) + 1
            if len(held) >= TASK_WORDS:
                yield frame()
                held.clear()
    if held:
        yield frame()


def gram_dictionary(words: DataFrame) -> tuple[dict[str, int], float]:
    """Counts of the more frequent grams, and the count above which a gram is lengthened.

    Grams above one place in ``GRAMS`` are at most ``GRAMS`` for each length, so what
    is collected is bounded.
    """
    places = words.agg(F.sum(F.length("word") + 1).alias("n")).first().n or 0
    least = max(2.0, places / GRAMS)
    grams = words.select("word").mapInPandas(_grams, "gram string, n long")
    counts = grams.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return {r.gram: r.n for r in counts.collect()}, max(FREQUENT * least, 64)


def decomposed(word: str, counts: dict[str, int], frequent: float) -> list[str]:
    """The gram that starts at each place of the marked word."""
    marked, out = f"^{word}$", []
    get, end = counts.get, len(word) + 2
    for at in range(end - SHORTEST + 1):
        size = SHORTEST
        while size < LONGEST and at + size < end and get(marked[at : at + size], 0) > frequent:
            size += 1
        out.append(marked[at : at + size])
    return out


def most_touched(grams: list[str]) -> int:
    """The most grams that cover one place behind the first: no edit touches more."""
    most = 0
    for place in range(1, len(grams) + 1):
        covers = sum(1 for back in range(min(LONGEST, place + 1)) if place - back < len(grams) and len(grams[place - back]) > back)
        most = max(most, covers)
    return most


def signature(word: str, counts: dict[str, int], frequent: float) -> list[tuple[str, int]]:
    """(gram, place) of the word's rarest grams, one more than an edit can touch, at all their places."""
    grams = decomposed(word, counts, frequent)
    order = sorted(grams, key=lambda g: (counts.get(g, 0), g))
    chosen = set(order[: most_touched(grams) + 1])
    return [(g, at) for at, g in enumerate(grams) if g in chosen]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of all pairs of words one edit apart, each once.

    The index holds words themselves below ``LONG_WORD`` code points and a digest for
    longer ones, whose texts come to the pairs that have met.
    """
    counts, frequent = gram_dictionary(words)
    sent = words.sparkSession.sparkContext.broadcast((counts, frequent))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, above = sent.value
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                size = len(word)
                text = word if size < LONG_WORD else None
                digest = hashlib.md5(word.encode()).hexdigest() if size >= LONG_WORD - 1 else None
                rows += [(g, at, size, text, digest, n) for g, at in signature(word, held, above)]
            yield pd.DataFrame(rows, columns=["gram", "at", "size", "word", "digest", "n"])

    index = stored(words.mapInPandas(sign, "gram string, at int, size int, word string, digest string, n long"), "grams")
    # a near word of the same length has the gram at the same place, a longer one there or one place on
    longer = lambda by, on: F.struct((F.col("size") + by).alias("size"), (F.col("at") + on).alias("at"))
    places = F.explode(F.array(longer(0, 0), longer(1, 0), longer(1, 1))).alias("k")
    asked = index.select("gram", F.col("word").alias("a"), F.col("digest").alias("d_a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"), places)
    asked = asked.select("gram", "k.size", "k.at", "a", "d_a", "n_a", "size_a")
    lists = index.select("gram", "size", "at", F.col("word").alias("b"), F.col("digest").alias("d_b"), F.col("n").alias("n_b"))
    by_text = (F.col("size_a") < F.col("size")) | (F.col("a") < F.col("b"))
    by_text = F.col("a").isNotNull() & F.col("b").isNotNull() & by_text & (F.levenshtein("a", "b", 1) == 1)
    by_digest = (F.col("a").isNull() | F.col("b").isNull()) & ((F.col("size_a") < F.col("size")) | (F.col("d_a") < F.col("d_b")))
    met = stored(asked.join(lists, ["gram", "size", "at"]).where(by_text | by_digest).select("a", "d_a", "n_a", "b", "d_b", "n_b").distinct(), "met")
    known = words.where(F.length("word") >= LONG_WORD - 1).select(F.md5("word").alias("d"), "word")
    far = met.where("a is null or b is null").select("d_a", "n_a", "d_b", "n_b")
    far = far.join(known.toDF("d_a", "a"), "d_a").join(known.toDF("d_b", "b"), "d_b").where(F.levenshtein("a", "b", 1) == 1)
    return met.where("a is not null and b is not null").select("a", "n_a", "b", "n_b").union(far.select("a", "n_a", "b", "n_b"))


# Forms


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by jumping: each round takes the root of the root so far."""
    ahead = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        there = ahead.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = stored(ahead.join(there, F.col("root") == F.col("at"), "left").select("word", "root", "next"), "roots")
        if step.where("next is not null").isEmpty():
            return ahead
        ahead = step.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    ``times``: how much more frequent than a word its form must be.
    """
    words = vocabulary(docs, id_col=id_col, text_col=text_col)
    pairs = stored(near_pairs(words), "pairs")
    both = pairs.select("a", "n_a", "b", "n_b").union(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "other", "n_other")
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n")
    )
    enough = F.col("other_n") >= times * F.col("n")
    told = told.select("word", "n", "n_near", F.when(enough, F.col("other")).alias("form"), F.when(enough, F.col("other_n")).alias("form_n"))
    told = stored(told, "forms")
    found = roots(told.where("form is not null")).withColumnRenamed("word", "r_word")
    return told.join(found, F.col("word") == F.col("r_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
