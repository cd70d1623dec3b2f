"""Statistics against plain counting, learned lists against planted rules, and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekin.llm import quality_rules as qr
from tablekin.llm.common import id_remainder, keyed


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeated = {j for own in places.values() if len(own) > 1 for i in own for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(repeated))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    word = lambda: draw.choice(["a", "b", "c d", "été", "#x|", "\x1c", "\xa0", "y z", "\r", "\v"])
    made = [draw.choice([" ", "\n", "\t"]).join(word() for _ in range(draw.randint(0, 60))) for _ in range(150)]
    phrase = "one two three four five six seven eight"
    return made + [None, "", "\n \n", phrase, f"{phrase} {phrase}", f"{phrase} nine {phrase}", "w " * 7, "w " * 8, "w " * 9, "same line\nsame line\n\nsame line "]


def test_counts_equal_plain_counting(spark, texts):
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = qr.report(frame, labels).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows} == {
        i: plain(t) for i, t in enumerate(texts)}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["rule"] is None and r["kept"] == (not r["base_failed"])


def test_planted_rules_are_found():
    draw = np.random.default_rng(1)
    table = {"words": draw.integers(1, 1000, 4000).astype(float), "symbol_share": draw.random(4000), "digit_share": draw.random(4000)}
    bad = (table["symbol_share"] > 0.8) | ((table["words"] <= 200) & (table["digit_share"] > 0.6))
    rules = qr.learn_rules(table, bad)
    said = np.zeros(4000, bool)
    for rule in rules:
        said |= qr._holds(rule, table, 4000)
    assert (said == bad).mean() > 0.98
    assert len(rules) <= 4 and all(len(rule) <= 2 for rule in rules[:2])


def test_no_rules_without_both_kinds_or_from_noise():
    draw = np.random.default_rng(3)
    table = {"words": draw.random(500)}
    assert qr.learn_rules(table, np.zeros(500, bool)) == [] and qr.learn_rules(table, np.ones(500, bool)) == []
    assert len(qr.learn_rules(table, draw.random(500) < 0.2)) <= 1


def test_expression_names_the_first_rule(spark):
    rules = [(qr.Condition("words", False, 5.0),), (qr.Condition("words", True, 2.0), qr.Condition("symbol_share", True, 0.5))]
    frame = spark.createDataFrame([(3, 1, 1), (9, 10, 9), (9, 10, 1), (0, 0, 0)], "n_words long, word_chars long, n_symbols long")
    assert [r[0] for r in frame.select(qr.failing_rule(rules)).collect()] == [1, 2, None, 1]
    assert qr.describe(rules)[1] == "words > 2 and symbol_share > 0.5"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = id_remainder(F.col("doc_id"), 5) == 0
    judged = qr.report(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").toPandas()
    judged = judged[~judged.base_failed]
    assert (judged.kept == (judged.quality == 1)).mean() > 0.95


def test_bound_repeats_and_clashing_columns(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good, "x") for i in range(30)] + [(100 + i, "## $$ " * 30, "x") for i in range(30)] + [(None, good, "y"), (5, good, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(130)] + [(None, 1), (4, None), (3, 1)], "doc_id long, quality int")
    kept = qr.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 32
    assert qr.report(docs.filter("doc_id > 900"), labels).collect() == []
    assert len(qr.report(docs, labels, bound=20).collect()) == len(rows)


def test_keys_differ_for_all_rows(spark):
    plain_ids = spark.createDataFrame([(2, "b"), (1, "a")], "doc_id long, text string")
    assert {(r["doc_id"], r["_key"]) for r in keyed(plain_ids, "text").collect()} == {(1, 1), (2, 2)}
    doubled = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a"), (None, "c"), (None, None), (1, "a")], "doc_id long, text string").repartition(4)
    rows = sorted(keyed(doubled, "text").collect(), key=lambda r: r["_key"])
    assert [(r["doc_id"], r["text"]) for r in rows] == [(None, None), (None, "c"), (1, "a"), (1, "a"), (1, "z"), (2, "b")]
