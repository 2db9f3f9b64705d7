"""The whole pipeline on an empty table, and on clashing names, nulls and repeated rows."""

from __future__ import annotations

import random

import pytest

from earshot.llm.common import stored

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Source string, TEXT int"


def result(spark, tmp_path, rows):
    """All stages over the rows, written and read between as ``run`` does."""
    items = [(1, "a benchmark item that nobody has ever written down before"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        names = docs.columns
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert name == "sharding" or docs.columns == names
    return docs


def prose(rnd, n):
    words = "the river runs past old houses and people talk about their day while children play near a quiet garden".split()
    return ". ".join(" ".join(rnd.choices(words + [f"name{rnd.randrange(900)}"], k=9)).capitalize() for _ in range(n))


def test_empty_table(spark, tmp_path):
    assert result(spark, tmp_path, []).count() == 0


def test_odd_rows_and_clashing_names(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, prose(rnd, 25), "en", "ab"[k % 2], 9, "own", k) for k in range(40)]
    rows += [(50, None, "en", "a", None, None, None), (51, "", None, None, 0, None, 1), (None, prose(rnd, 25), "en", None, 9, "x", 2)]
    rows += [rows[3], rows[3], (60, rows[4][1], "en", "b", 9, "copy", 3)]
    out = result(spark, tmp_path, rows).collect()
    kept = {r.doc_id for r in out}
    assert kept and 50 not in kept and 51 not in kept and 60 not in kept
    assert len({r.slot for r in out if r.shard == 0}) == sum(r.shard == 0 for r in out)
