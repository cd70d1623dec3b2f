"""Licence scans on variants they have not seen, and on other text."""

import random

import numpy as np
import pytest

from tablekin.llm import licenses as li
from tablekin.llm.near_dedup import words_of


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(docs)


def test_notices_inside_other_text(model, docs):
    lines = [line for row in docs.limit(60).collect() for line in row["text"].split("\n") if len(line) < 200]
    draw, right = random.Random(77), 0
    cases = [(family, notice) for family, notices in li.NOTICES.items() for notice in notices]
    for family, notice in cases:
        text = "\n".join([draw.choice(lines), notice + ".", draw.choice(lines)])
        (_, found), = li.scan([text], model, li.WordIds())
        right += any(f == family and sure for (_, _, f), sure in found)
    assert right >= 0.9 * len(cases)


def test_all_documents_against_plain_search(spark, docs):
    told = {"CC BY-NC 4.0": "CC-BY-NC", "Apache License": "Apache", "GNU General Public": "GPL", "MIT License": "MIT"}
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    rows = {row["doc_id"]: row for row in li.report(docs).collect()}
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        expected = {family for said, family in told.items() if said in text}
        assert set(filter(None, rows[key]["families"].split(","))) == expected
        assert rows[key]["n_paragraphs"] == sum(bool(words_of(line)) for line in text.split("\n"))
        for span in filter(None, rows[key]["spans"].split(",")):
            family, a, b = span.split(":")
            assert any(said in text[int(a):int(b)] for said, f in told.items() if f == family)


def test_near_misses_are_unknown(model):
    unseen = ["The licensed taxi waited in general traffic", "Apache county is a public place with a library", "Version 2 of the plan was released"]
    assert all(not any(sure for _, sure in found) for _, found in li.scan(li.NEAR_MISSES + unseen, model, li.WordIds()))


def test_windows_and_features():
    for n in [0, 1, 40, 41, 60, 61, 100]:
        seen = {w for a, b in li.units(n) for w in range(a, b)}
        assert seen == set(range(n)) and all(b - a <= li.WINDOW for a, b in li.units(n))
    model = li.Classifier()
    model.weights[:-1] = np.random.default_rng(0).normal(size=(li.FEATURES, li.UNKNOWN + 1))
    ids = li.WordIds()
    windows = [words_of("one two three"), words_of("four"), words_of("one two three")]
    together = model.logits(*li.feature_rows(windows, ids))
    for one, logits in zip(windows, together):
        assert np.allclose(model.logits(*li.feature_rows([one], ids)), logits, atol=1e-4)


def test_nulls_repeats_long_lines_and_empty(spark):
    notice = "Released under the MIT License."
    frame = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, notice, "x"), (2, "word " * 5000 + notice + " word" * 5000, "x"), (2, notice, "x")],
                                  "doc_id long, text string, families string")
    got = sorted((str(r["doc_id"]), r["n_paragraphs"], r["families"]) for r in li.report(frame).collect())
    assert got == [("1", 0, ""), ("1", 0, ""), ("2", 1, "MIT"), ("2", 1, "MIT"), ("None", 1, "MIT")]
    assert li.report(frame.filter("doc_id > 5")).collect() == []
