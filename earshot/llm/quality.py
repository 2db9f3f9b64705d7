"""Quality rules with weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics.
Vote patterns are counted over all documents; with r rules there are at most
3**r patterns, so these counts, and nothing that grows with the corpus, reach the
driver. Expectation-maximisation over them estimates how often each rule votes
right, and every document gets the posterior probability of being good.

Defined results: a null text has no words and fails; an empty table gives an
empty result; repeated rows and null ids are judged row by row; other columns are
kept by ``keep_good`` and ignored by ``quality_verdicts``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, pick, stored

SYMBOLS = "#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
LEADS = bytes(range(0xC0, 0x100))  # first bytes of code points beyond ASCII
DIGITS = b"0123456789"
MARKED = re.compile(rb"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*")  # a word with a symbol
STATS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_letters",
    "n_digits",
    "n_stops",
    "n_marked",
)


def repeat_words(words: Sequence[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    if len(codes) == n:
        return 0
    _, pairs = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    found = counts[windows] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= found
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The numbers of STATS for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    upper = without(UPPER)
    symbols = sum(map(text.count, SYMBOLS))
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        symbols,
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        upper,
        upper + without(LOWER + LEADS),
        without(DIGITS),
        sum(map(text.count, ".?")),
        len(MARKED.findall(raw)) if symbols else 0,
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in STATS]))
def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=STATS, dtype="int64")


def text_statistics(text: Column | str) -> Column:
    """A struct of the STATS of a text."""
    return _stats(text)


@dataclass(frozen=True)
class Rule:
    """A named rule: SQL conditions for a bad and for a good vote, else it abstains."""

    name: str
    bad: str
    good: str

    def vote(self, stats: str) -> Column:
        at = lambda sql: F.expr(sql.replace("$", f"{stats}."))
        return F.when(at(self.bad), -1).when(at(self.good), 1).otherwise(0)


# Thresholds of the rules.
RULES = (
    Rule("length", "$n_words < 50", "$n_words >= 100"),
    Rule("symbols", "$n_symbols * 10 > $n_words", "$n_symbols * 50 <= $n_words"),
    Rule("marked_words", "$n_marked * 10 > $n_words", "$n_marked * 50 <= $n_words"),
    Rule("letters", "$n_letters * 100 < $word_chars * 78", "$n_letters * 100 >= $word_chars * 88"),
    Rule("shouting", "$n_upper * 2 > $n_letters", "$n_upper * 5 < $n_letters"),
    Rule("repeats", "$n_repeat_words * 3 > $n_words", "$n_repeat_words * 10 < $n_words"),
    Rule("lines", "$n_dup_lines * 3 > $n_lines", "$n_dup_lines * 10 <= $n_lines"),
    Rule("word_length", "$word_chars < 2 * $n_words or $word_chars > 14 * $n_words", "$word_chars between 3 * $n_words and 10 * $n_words"),
    Rule("sentences", "$n_stops * 120 < $n_words", "$n_stops * 60 >= $n_words"),
    Rule("digits", "$n_digits * 5 > $word_chars", "$n_digits * 20 <= $word_chars"),
)


@dataclass(frozen=True)
class VoteModel:
    """Log-odds of good against bad: a constant and one term per rule and vote."""

    prior: float
    terms: tuple[dict[int, float], ...]

    def posterior(self, votes: Sequence[Column]) -> Column:
        odds = F.lit(self.prior)
        for vote, term in zip(votes, self.terms, strict=True):
            odds = odds + F.when(vote == 1, term[1]).when(vote == -1, term[-1]).otherwise(term[0])
        return 1.0 / (1.0 + F.exp(-odds))


def fit_votes(patterns: Sequence[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    Posteriors start from the share of good votes among those cast, which also
    fixes which class is called good. One pseudo-document a cell keeps every
    probability above zero. Only votes that are cast count: that a rule abstains
    is taken to say nothing about the class, and a rule is taken to be no worse
    than chance: a bad vote never counts for good, nor the other way round.
    """
    if not patterns:
        return VoteModel(0.0, tuple({1: 0.0, 0: 0.0, -1: 0.0} for _ in range(rules)))
    patterns = sorted(patterns)
    votes = np.array([p for p, _ in patterns])
    counts = np.array([c for _, c in patterns], float)
    cast = np.maximum(np.abs(votes).sum(1), 1)
    good = 0.5 + 0.45 * votes.sum(1) / cast
    for _ in range(rounds):
        weight = np.stack([counts * good, counts * (1 - good)])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        table = np.zeros((2, rules, 3))
        for k, value in enumerate((-1, 0, 1)):
            table[:, :, k] = weight @ (votes == value) + 1
        chance = table[:, :, (0, 2)] / table[:, :, (0, 2)].sum(2, keepdims=True)
        logs = np.log(chance[0] / chance[1])
        logs = np.stack([np.minimum(logs[:, 0], 0), np.maximum(logs[:, 1], 0)], 1)
        odds = math.log(prior[0] / prior[1]) + (votes == -1) @ logs[:, 0] + (votes == 1) @ logs[:, 1]
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    terms = tuple({-1: float(a), 0: 0.0, 1: float(b)} for a, b in logs)
    return VoteModel(math.log(prior[0] / prior[1]), terms)


def _vote_columns(rules: Sequence[Rule], stats: str) -> list[Column]:
    return [rule.vote(stats).alias(f"vote_{i}") for i, rule in enumerate(rules)]


def fit_rules(stats: DataFrame, rules: Sequence[Rule] = RULES, column: str = "stats") -> VoteModel:
    """Fit on the vote patterns of all rows of ``stats``."""
    patterns = stats.select(*_vote_columns(rules, column))
    found = patterns.groupBy(*patterns.columns).count().collect()  # at most 3 ** len(rules) rows
    return fit_votes([(tuple(row[:-1]), row[-1]) for row in found], len(rules))


def verdict(model: VoteModel, rules: Sequence[Rule], stats: str) -> tuple[Column, Column, Column]:
    """(base_failed, kept, posterior) as columns over the struct ``stats``."""
    base = F.expr("$n_words < 50 or 100 * $n_repeat_words > 50 * $n_words".replace("$", f"{stats}."))
    posterior = model.posterior(_vote_columns(rules, stats))
    return base, ~base & (posterior >= 0.5), posterior


def quality_verdicts(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, statistics, base_failed, kept, posterior) of every row.

    The statistics are read off the texts once and stored, a few numbers a row,
    in the shared folder; fitting and judging work on those.
    """
    rows = pick(docs, id_col, text_col)
    stats = stored(rows.select(id_col, _stats(text_col).alias("stats")), "quality")
    base, kept, posterior = verdict(fit_rules(stats, rules), rules, "stats")
    return stats.select(
        id_col,
        *[f"stats.{s}" for s in STATS[:5]],
        base.alias("base_failed"),
        kept.alias("kept"),
        posterior.alias("posterior"),
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``quality_verdicts`` keeps.

    The texts are read twice, to fit and to judge, so that no copy of them is
    shuffled or stored.
    """
    model = fit_rules(pick(docs, text_col).select(_stats(text_col).alias("stats")), rules)
    places = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*places)
    judged = flat.withColumn("stats", _stats(places[docs.columns.index(text_col)]))
    return judged.where(verdict(model, rules, "stats")[1]).select(*places).toDF(*docs.columns)
