"""License scan of a file that holds every notice."""

from __future__ import annotations

from earshot.llm import license_scan


def test_file_with_all_notices(spark):
    notices = [f"{t.text.capitalize()}. (part {k})" for k, t in enumerate(license_scan.TEMPLATES)]
    rows = [(0, "\n\n".join(notices)), (1, "\n\n".join(reversed(notices)))]
    rows += [(10 + i, "released under the mit license, licensed under the gnu general public license version") for i in range(30)]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in got.where("doc_id < 2").collect():
        assert {m.label: m.score for m in r.found} == {t.label: 1.0 for t in license_scan.TEMPLATES}


def test_labels_and_scores(spark):
    """Labels and scores by a plain count of places on one start."""
    texts = [" ".join(t.text.split()[: len(t.text.split()) - cut]) for t in license_scan.TEMPLATES for cut in range(6)]
    texts += ["nothing here", "", None, "open to all", "the mit license"]
    want = {}
    for i, text in enumerate(texts):
        words = (text or "").split()
        for t in license_scan.TEMPLATES:
            rare = [(q, w) for q, w in enumerate(t.text.split()) if w not in license_scan.COMMON]
            votes = max((sum(0 <= s + q < len(words) and words[s + q] == w for q, w in rare) for s in range(-40, 40)), default=0)
            if votes / len(rare) >= license_scan.VOTE_SHARE and all(f" {k} " in f" {' '.join(words)} " for k in t.keys):
                want[i, t.label] = votes / len(rare)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    phrases = (("open", "open to all"), ("common", "to use"), ("single", "mit"))
    got = license_scan.license_scan(docs, phrases=phrases).collect()
    assert {(r.doc_id, m.label): m.score for r in got for m in r.found} == want and len(want) > 12
    base = {(r.doc_id, m.label, m.pos) for r in got for m in r.base}
    assert base == {
        (i, label, p)
        for i, text in enumerate(texts)
        for label, phrase in phrases
        for p in range(len((text or "").split()))
        if (text or "").split()[p : p + len(phrase.split())] == phrase.split()
    }
