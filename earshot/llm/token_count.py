"""Token counts with a whole-token shortcut.

Offline (on the driver, once per vocabulary file) every vocabulary string that
ends a word is encoded alone; those that come back as their own single token are
*proven*. In the tasks a pre-token that is proven counts as one token straight
away and only the others go through the merges. White space never joins two
pre-tokens, so counts are memoised per white-space word.

Defined results: a null text counts as empty (0 tokens); special strings inside
a text are one token each, as the library reads them; repeated rows, ties and
null ids are counted row by row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import pick

MEMO_WORDS = 500_000  # entries of the memo of a task; it is emptied beyond
MEMO_LENGTH = 64  # longer words are counted without the memo
NOT_SPACE = re.compile("[\x1c-\x1f]")  # str.split() takes these as white space, the tokenizer does not


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def proven_words(spec: str) -> frozenset[str]:
    """Vocabulary strings that, encoded alone, are exactly their own one token."""
    tokenizer = Tokenizer.from_str(spec)
    end = json.loads(spec)["model"]["end_of_word_suffix"]
    back = {c: b for b, c in byte_alphabet().items()}
    words, ids = [], []
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith(end) and all(c in back for c in token[: -len(end)]):
            try:
                words.append(bytes(back[c] for c in token[: -len(end)]).decode())
                ids.append(number)
            except UnicodeDecodeError:
                continue
    coded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, i, e in zip(words, ids, coded, strict=True) if e.ids == [i])


class WordCounts(dict):
    """Tokens of a white-space word, filled on demand."""

    def __init__(self, spec: str, proven: frozenset[str]):
        self.proven = proven
        self.tokenizer = Tokenizer.from_str(spec)
        described = json.loads(spec)
        split = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        specials = [t["content"] for t in described["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))) or r"(?!)")
        self.bytes = byte_alphabet()
        self.sure: set[str] = set(map(chr, range(128)))
        self.unsure: set[str] = set()

    def merged(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize("".join([self.bytes[b] for b in piece.encode()])))

    def of_word(self, word: str) -> int:
        if word in self.proven and len(self.pieces.findall(word)) == 1:
            return 1
        return sum(1 if p in self.proven else self.merged(p) for p in self.pieces.findall(word))

    def __missing__(self, word: str) -> int:
        n = self.of_word(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n

    def agrees(self, char: str) -> bool:
        """Do this Python's character tables and the tokenizer's treat it alike?"""
        if unicodedata.ucd_3_2_0.category(char) == "Cn" and unicodedata.combining(char):
            return False
        mine = unicodedata.normalize("NFC", "b" + char).replace("Σ", "σ").lower()
        theirs = self.tokenizer.normalizer.normalize_str("b" + char)
        probe = theirs + theirs[1:] + "1"
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)
        return regex.sub(r"\s+", " ", mine) == theirs and len(cut) == len(self.pieces.findall(probe))

    def of_plain(self, text: str) -> int:
        if not text.isascii():
            for char in set(text) - self.sure - self.unsure:
                (self.sure if self.agrees(char) else self.unsure).add(char)
            if self.unsure and not self.unsure.isdisjoint(text):
                return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if NOT_SPACE.search(text):
            return self.of_word(text)
        return sum(map(self.__getitem__, text.split()))

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.of_plain, parts))


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    ``vocabulary`` is the path of a tokenizer description in JSON (byte-level
    BPE with word ends). It is read on the driver; the description and its
    proven words, both bounded by the vocabulary, go to the tasks.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, proven_words(spec)))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = WordCounts(*sent.value)
        for texts in batches:
            yield pd.Series([counts.of_text(t) for t in texts], dtype="int64")

    rows = pick(docs, id_col, text_col)
    return rows.select(
        id_col,
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        count(text_col).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
