"""The stages of the pipeline against brute force on planted cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from earshot.llm import near_copies

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LEAK = "The onou and ersh ntedly esha, onerbleretion thonthwh onblees, antion edhash thednt anesat and esing thatly eron."


def prose(rnd, n):
    parts = [" ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(12)) for _ in range(n)]
    return " ".join(p.capitalize() + "." for p in parts)


def table():
    rnd = random.Random(21)
    clean = {i: prose(rnd, 12) for i in range(40)}
    texts = dict(clean)
    texts |= {100: clean[3], 101: clean[3], 102: clean[5].replace(clean[5].split()[70], "changed", 1)}
    texts |= {200: clean[7] + " " + LEAK, 201: prose(rnd, 6) + " " + LEAK.replace("esha", "esho") + prose(rnd, 4)}
    texts |= {300: "too short", 301: None, 302: "", 303: " ".join(w + "%%%" for w in prose(rnd, 12).split())}
    texts |= {202: prose(rnd, 9) + " " + LEAK}
    texts |= {304: " | ".join(prose(rnd, 12).split()), 305: "same same same " * 60}
    return [(i, t, "en", f"src{i % 3}", 0) for i, t in texts.items()], set(clean)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, _ = table()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, sf_dir):
    rows, clean = table()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    assert ids(good) == ids(docs) - {300, 301, 302, 303, 304, 305}
    once = stages["near_dedup"](spark, good, sf_dir)
    assert once.columns == docs.columns and once.count() == len(ids(once))
    # 200 shares 140 of 159 five-word shingles with 7: 0.88
    assert ids(once) == ids(good) - {100, 101, 102, 200}
    free = stages["decontamination"](spark, once, sf_dir)
    assert free.columns == docs.columns and ids(free) == clean
    mixed = stages["source_mix"](spark, free, sf_dir)
    assert mixed.columns == docs.columns and ids(mixed) <= clean
    counts = [r["count"] for r in mixed.groupBy("doc_id").count().collect()]
    assert max(counts) == 2
    shards = stages["sharding"](spark, mixed, sf_dir)
    assert shards.count() == mixed.count()
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(tuple(r) for r in whole.groupBy("doc_id").count().collect()) == sorted(tuple(r) for r in shards.groupBy("doc_id").count().collect())


def test_rows_that_share_id_and_text(spark):
    rnd = random.Random(2)
    text = prose(rnd, 10)
    rows = [(7, text, "en", "a", 0)] * 3 + [(None, text, "en", "a", 0), (None, None, "en", "a", 0), (8, prose(rnd, 10), "en", "a", 0)]
    left = near_copies.without_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in left if r.text) == [(False, 7), (False, 8)] and len(left) == 3
