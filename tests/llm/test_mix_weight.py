"""The draw of the source mix follows the posterior of the quality rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from earshot.llm import mixing, quality

GOOD = "the river runs past a quiet mill and the old bridge near town was built of stone"


def corpus(spark):
    rnd = random.Random(29)
    words = GOOD.split()
    rows = []
    for i in range(1200):
        text = ". ".join(" ".join(rnd.choice(words) + str(rnd.randrange(3)) * (rnd.random() < 0.1) for _ in range(12)) for _ in range(10))
        if i % 3 == 0:
            text = " ".join(rnd.choice(("BUY", "#1", "$$$", "99|99", "<<>>", "NOW")) for _ in range(120))
        rows.append((i, text, "ab"[i % 2]))
    rows += [(2000, None, "a"), (None, GOOD, None), (2001, "", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_keys_are_draws_over_the_posterior(spark):
    docs = corpus(spark)
    posterior = {r.doc_id: r.posterior for r in quality.quality_verdicts(docs).collect()}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(10), "doc_id", "text"), 11)
    plain = {r.doc_id: r.key for r in docs.select("doc_id", (-F.log((draw + 0.5) / float(1 << 53))).alias("key")).collect()}
    keyed = mixing._with_key(docs.toDF("m_id", "m_text", "m_source"), "m_id", "m_text", 10).collect()
    assert len(keyed) == docs.count()
    for r in keyed:
        weight = 0.1 + 0.9 * posterior[r.m_id]
        assert r.m_key * weight == pytest.approx(plain[r.m_id], rel=1e-9), r.m_id


def test_good_documents_are_drawn_first_and_poor_ones_still_come(spark):
    docs = corpus(spark)
    posterior = {r.doc_id: r.posterior for r in quality.quality_verdicts(docs).collect()}
    got = mixing.mix_sources(docs, weights=(1,), share=0.4).where("size > 0 and doc_id is not null").collect()
    good = [r.taken > 0 for r in got if posterior[r.doc_id] > 0.9]
    poor = [r.taken > 0 for r in got if posterior[r.doc_id] < 0.1]
    assert len(good) > 700 and len(poor) > 350
    assert sum(good) / len(good) > 2 * sum(poor) / len(poor) > 0


def test_texts_are_read_once(spark):
    plan = mixing.mix_sources(corpus(spark))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan  # statistics are read off the stored table
