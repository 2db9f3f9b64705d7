"""License scans by a positional rare-token index, on DataFrame functions only.

Templates of licence texts are indexed by their rare words, those of the highest idf over
all templates, weighted by length: (word, template, place). Each file looks up all of these words it holds; an
occurrence at place p that a template has at place q votes for that template
starting at p - q, and templates with enough votes on one start are kept if all
their mandatory key phrases stand in the file. Fixed base phrases are looked for besides, word by word.

Words are runs of ASCII letters and digits and of all code points beyond ASCII,
A-Z lower-cased. What is stored between the steps is the words' places of licence
words, not the texts.

Defined results: a null or empty text has no words, no labels and score 0; very
long texts are scanned whole; repeated rows and null ids are scanned row by row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored
from .licence_texts import TEXTS

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VOTE_SHARE = 0.7  # of a template's licence words, on one start


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


def _plain(text: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", text.lower()))


TEMPLATES = tuple(Template(label, _plain(text), keys) for label, text, keys in TEXTS)
# Base phrases.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
RARE = 8  # words of the highest weight that a template brings into the index, half of its words at most
TELLING = 3.0  # weight from which on a word of a base phrase is looked up too


def word_weights(templates: Sequence[Template]) -> dict[str, float]:
    """Each word's idf over the templates times its length: short words are frequent in any text."""
    held = Counter(w for t in templates for w in set(t.text.split()))
    return {w: math.log(len(templates) / n) * len(w) for w, n in held.items()}


def rare_words(templates: Sequence[Template], phrases: Sequence[tuple[str, str]]) -> set[str]:
    """The words of highest weight of each template, and those of the phrases that weigh enough."""
    weights = word_weights(templates)
    words = [sorted(set(t.text.split()), key=lambda w: (-weights[w], w)) for t in templates]
    telling = {w for _, p in phrases for w in p.split() if weights.get(w, TELLING) >= TELLING}
    return telling | {w for found in words for w in found[: min(RARE, max(2, len(found) // 2))]}


# Words of the templates that are not looked up.
COMMON = frozenset(w for t in TEMPLATES for w in t.text.split()) - rare_words(TEMPLATES, BASE_PHRASES)


def licence_words(templates: Sequence[Template], phrases: Sequence[tuple[str, str]]) -> list[str]:
    """Words to look up: of templates and phrases all but common ones, and all of a phrase of common words only."""
    texts = [t.text for t in templates] + [p for _, p in phrases]
    rare = {w for text in texts for w in text.split()} - COMMON
    return sorted(rare | {w for _, p in phrases if not rare & set(p.split()) for w in p.split()})


def fewest_words(templates: Sequence[Template], phrases: Sequence[tuple[str, str]]) -> int:
    """Different looked-up words that a file must hold to match anything."""
    vocabulary = set(licence_words(templates, phrases))
    needs = [len(vocabulary & set(p.split())) for _, p in phrases]
    for t in templates:  # votes that may be missing can each take a word away
        needs.append(len(set(t.text.split()) - COMMON) - math.floor((1 - VOTE_SHARE) * _indexed_words(t)))
    return max(1, min(needs, default=1))


def _words(text: str) -> Column:
    """Lower-cased words. The Kelvin sign is the only other code point that lower() takes to ASCII."""
    lowered = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("é")))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _places(label: str, phrase: str) -> Column:
    """Starts of a phrase, found from the places of its rarest-looking word, its longest if all are common."""
    words = phrase.split()
    k = max(range(len(words)), key=lambda i: (words[i] not in COMMON, words[i] != "under", len(words[i])))
    rest = "".join(f" and get(words, h.pos + {i - k}) = '{w}'" for i, w in enumerate(words) if i != k)
    hit = f"filter(hits, h -> h.w = '{words[k]}'{rest})"
    return F.expr(f"transform({hit}, h -> named_struct('label', '{label}', 'pos', h.pos - {k}))")


def _indexed(
    docs: DataFrame, templates: Sequence[Template], phrases: Sequence[tuple[str, str]], id_col: str, text_col: str
) -> DataFrame:
    """Per row: n_words, places of licence words, base places, templates whose key phrases all occur."""
    vocabulary = ", ".join(f"'{w}'" for w in licence_words(templates, phrases))
    rows = pick(docs, id_col, text_col).toDF("l_id", "l_text").select("l_id", _words("l_text").alias("words"))
    hits = f"filter(transform(words, (w, i) -> named_struct('w', w, 'pos', i)), x -> x.w in ({vocabulary}))"
    rows = rows.withColumn("hits", F.expr(hits))
    near = F.size(F.array_distinct("hits.w")) >= fewest_words(templates, phrases)  # other files need no closer look
    base = F.flatten(F.array(*[_places(*p) for p in phrases]))
    joined = F.when(near, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    rows = rows.withColumn("base", F.when(near, base)).withColumn("joined", joined)
    having = [
        F.when(F.expr(" and ".join(f"contains(joined, ' {k} ')" for k in t.keys)), F.lit(i))
        for i, t in enumerate(templates)
    ]
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "l_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(near, F.col("hits")).alias("hits"),
        "base",
        F.when(near, F.array_compact(F.array(*having))).alias("keyed"),
    )


def _votes(indexed: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(row, template, score): the best start of each template with enough votes."""
    spark = indexed.sparkSession
    postings = [
        (i, w, q) for i, t in enumerate(templates) for q, w in enumerate(t.text.split()) if w not in COMMON
    ]
    if not postings:
        return spark.sql("select 0L as row, 0 as template, 0d as score where false")
    values = ", ".join(f"({i}, '{w}', {q})" for i, w, q in postings)
    index = spark.sql(f"select * from values {values} as (template, w, q)")
    need = F.create_map(*[F.lit(x) for i, t in enumerate(templates) for x in (i, _indexed_words(t))])
    rows = indexed.where(F.col("hits").isNotNull()).select("row", F.explode("hits").alias("hit"))
    rows = rows.select("row", F.col("hit.w").alias("w"), F.col("hit.pos").alias("pos"))
    votes = rows.join(F.broadcast(index), "w").groupBy("row", "template", (F.col("pos") - F.col("q")).alias("start"))
    score = F.col("count") / F.element_at(need, F.col("template"))
    best = votes.count().withColumn("score", score).where(F.col("score") >= VOTE_SHARE)
    return best.groupBy("row", "template").agg(F.max("score").alias("score"))


def _indexed_words(template: Template) -> int:
    return sum(w not in COMMON for w in template.text.split())


def license_scan(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_words, base, found) of every row.

    ``base`` holds (label, pos) of each base phrase, ``found`` (label, score) of
    each template the index finds and the key phrases confirm.
    """
    indexed = stored(_indexed(docs, templates, phrases, id_col, text_col), "license")
    votes = _votes(indexed, templates)
    names = F.array(*[F.lit(t.label) for t in templates])
    entry = F.struct("template", F.get(names, F.col("template")).alias("label"), F.least("score", F.lit(1.0)).alias("score"))
    matched = votes.groupBy("row").agg(F.collect_list(entry).alias("matched"))
    both = indexed.drop("hits").join(matched, "row", "left")
    found = F.expr("filter(matched, m -> array_contains(keyed, m.template))")
    return both.select(
        F.col("l_id").alias(id_col),
        "n_words",
        F.coalesce("base", F.expr("array()")).alias("base"),
        F.coalesce(F.transform(found, lambda m: F.struct(m.label.alias("label"), m.score.alias("score"))), F.expr("array()")).alias("found"),
    )


def license_labels(docs: DataFrame) -> DataFrame:
    """Word and place counts, base labels, all labels and the best score, per document."""
    scanned = license_scan(docs)
    told = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.array_max(F.transform("found", lambda m: m.score))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.pos").cast("long").alias("first_word"),
        F.array_max("base.pos").cast("long").alias("last_word"),
        told(F.col("base.label")).alias("base_labels"),
        told(F.concat("base.label", "found.label")).alias("labels"),
        F.greatest(F.coalesce(own, F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
