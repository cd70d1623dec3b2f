import math

import pytest
from pyspark.sql import functions as F

from tablekin.functions.text import ngrams, word_tokens
from tablekin.operators import features, pooling
from tablekin.schema import MARK
from tests.helpers import lake_of, rows


def weights(df) -> dict:
    return {(r["table_name"], r["dim"]): r["weight"] for r in df.collect()}


def test_words(spark):
    frame = spark.createDataFrame([("Été a_1 b-2, X",)], "t string")
    row = frame.select(word_tokens(F.col("t")), word_tokens(F.col("t"), 2)).first()
    assert row[0] == ["été", "a_1", "b", "2", "x"] and row[1] == ["été", "a_1"]


@pytest.mark.parametrize(("words", "before", "low", "high", "expected"), [
    (["a", "b", "c"], 0, 1, 2, ["a", "b", "c", "a b", "b c"]),
    (["a", "b", "c"], 1, 1, 2, ["b", "c", "a b", "b c"]),
    (["a", "b", "c", "d"], 2, 3, 3, ["a b c", "b c d"]),
    (["a"], 0, 2, 3, []), ([], 0, 1, 2, [])])
def test_ngrams(spark, words, before, low, high, expected):
    frame = spark.createDataFrame([(words, before)], "w array<string>, n int")
    assert frame.select(ngrams(F.col("w"), F.col("n"), low, high)).first()[0] == expected


@pytest.mark.parametrize("high", [1, 2, 3])
def test_terms_run_across_values(spark, high):
    values = ["red the apple", "the", "pie x y", "", "z"]
    cells, meta = lake_of(spark, {("lake", "t"): {"c": values}})
    read = features.column_values(cells, meta, 10)
    ordered = [r["value"] for r in read.orderBy("rn").collect()]
    words = [w for v in ordered for w in v.split() if w != "the"]
    expected: dict[str, int] = {}
    for n in range(1, high + 1):
        for i in range(len(words) - n + 1):
            gram = " ".join(words[i:i + n])
            expected[gram] = expected.get(gram, 0) + 1
    got = features.term_counts(read, ["the"], (1, high))
    assert {r["term"]: r["tf"] for r in got.collect()} == expected


def test_tfidf_by_hand(spark):
    cells, meta = lake_of(spark, {
        ("lake", "a"): {"c": ["red apple"]}, ("lake", "b"): {"c": ["red pear"]},
        ("lake", "e"): {"c": [None]}, ("query", "q"): {"c": ["pear plum"]}})
    counts = features.term_counts(features.column_values(cells, meta), [], (1, 1))
    terms = features.idf_weights(features.vocabulary(counts), features.text_count(meta))
    idf = {r["term"]: r["idf"] for r in terms.collect()}
    assert idf == pytest.approx({"red": math.log(4 / 3) + 1, "apple": math.log(2) + 1,
                                 "pear": math.log(2) + 1})
    ids = {r["term"]: r["term_id"] for r in terms.collect()}
    assert ids == {"red": 0, "apple": 1, "pear": 2}
    got = weights(features.tfidf_vectors(counts, terms, meta))
    assert got == pytest.approx({
        ("a", 0): 0.605349, ("a", 1): 0.795961, ("b", 0): 0.605349, ("b", 2): 0.795961,
        ("q", 2): 1.0, **{(t, MARK): 0.0 for t in "abeq"}}, abs=1e-6)


def test_vocabulary_is_the_most_frequent_of_all_corpora(spark):
    cells, meta = lake_of(spark, {("lake", "a"): {"c": ["x x y"]}, ("query", "q"): {"c": ["z z z"]}})
    extra_cells, extra_meta = lake_of(spark, {("extra", "e"): {"c": ["y y w"]}})
    counts = features.term_counts(features.column_values(cells, meta), [], (1, 1))
    extra = features.term_counts(features.column_values(extra_cells, extra_meta), [], (1, 1))
    got = features.vocabulary(counts, 2, [extra]).orderBy("term_id").collect()
    assert [(r["term"], r["tf"], r["df"]) for r in got] == [("y", 3, 2), ("x", 2, 1)]
    assert features.text_count(meta, [extra_meta]).first()["n_docs"] == 2


def test_hash_skips_blank_columns_and_counts_do_not(spark):
    cells, meta = lake_of(spark, {
        ("lake", "t"): {"a": ["one two"], "b": [" "], "c": [None], "d": ["-"]},
        ("lake", "none"): {"a": [None]}})
    hashed = features.hash_vectors(features.column_values(cells, meta), 64)
    assert rows(features.unit_counts(hashed), "table_name", "n_units") == [("t", 2)]
    counted = features.count_vectors(
        features.term_counts(features.column_values(cells, meta), [], (1, 1)),
        spark.createDataFrame([("one", 0)], "term string, term_id int"), meta)
    assert rows(features.unit_counts(counted), "table_name", "n_units") == [("none", 1), ("t", 4)]
    mean = weights(pooling.table_vectors(counted, "mean").filter("dim >= 0"))
    assert mean == {("t", 0): 0.25}


def test_names_come_first(spark):
    cells, meta = lake_of(spark, {("lake", "t"): {"city": ["new york"], "note": [None]}})
    values = features.column_values(cells, meta, 5, include_names=True)
    terms = features.term_counts(values, [], (1, 2)).filter("col_pos = 0")
    assert rows(terms, "term") == [("city",), ("city new",), ("new",), ("new york",), ("york",)]
    assert rows(features.unit_counts(features.hash_vectors(values)), "n_units") == [(2,)]
