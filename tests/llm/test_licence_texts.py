"""Real headers, wrapped and commented as they stand in files."""

from __future__ import annotations

import textwrap

import pytest

from earshot.llm import license_scan
from earshot.llm.licence_texts import TEXTS

COMMENTS = {"c": ("/*", " * ", " */"), "hash": ("", "# ", ""), "slashes": ("", "// ", ""), "plain": ("", "", "")}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for k, (label, text, _) in enumerate(TEXTS):
        for j, (first, lead, last) in enumerate(COMMENTS.values()):
            body = textwrap.indent(textwrap.fill(f"Copyright (c) 2020 Some Body. {text} More words follow here.", 60), lead)
            rows.append((k * 10 + j, f"{first}\n{body}\n{last}\ncode = 1\n"))
    rows += [(10_001, "This program is free to use, as the public does. Permission was granted; the software has no warranty."), (10_002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: set(r.labels.split(",")) - {""} for r in license_scan.license_labels(df).collect()}


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_header_is_labelled_in_every_comment(labelled, k):
    for j in range(len(COMMENTS)):
        assert TEXTS[k][0] in labelled[k * 10 + j]


def test_relatives_are_told_apart(labelled):
    names = [label for label, *_ in TEXTS]
    for family in (("gpl-2-header", "gpl-3-header", "lgpl-2-1-header", "lgpl-3-header", "agpl-3-header"), ("cc-by-4-notice", "cc-by-sa-4-notice"), ("mit-grant", "boost-1-grant")):
        for label in family:
            assert labelled[names.index(label) * 10] & set(family) == {label}


def test_prose_has_no_label(labelled):
    assert labelled[10_001] == set() and labelled[10_002] == set()


def test_rare_words_weigh_most():
    weights = license_scan.word_weights(license_scan.TEMPLATES)
    for t in license_scan.TEMPLATES:
        words = set(t.text.split())
        rare = words - license_scan.COMMON
        assert len(rare) >= min(license_scan.RARE, max(2, len(words) // 2))
    assert weights["noninfringement"] == max(weights.values()) and {"the", "and", "an", "can"} <= license_scan.COMMON
    assert license_scan.fewest_words(license_scan.TEMPLATES, license_scan.BASE_PHRASES) >= 2
