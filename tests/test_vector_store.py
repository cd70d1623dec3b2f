"""Refreshed vectors equal those made anew, and only changed tables are worked through."""

import pytest
from pyspark.sql import functions as F

from tablekin.plans.ranking import dense_vectors, full_params, sparse_vectors
from tablekin.plans.stored_vectors import refreshed_vectors
from tablekin.sources.vector_store import VectorStore, table_prints
from tests.helpers import lake_of, rows

VERSION_1 = {("lake", "colors"): {"c": ["red", "blue", None], "n": ["1", "2", "3"]},
             ("lake", "fruits"): {"c": ["apple", "pear", "plum"]},
             ("lake", "gone"): {"g": ["red"]}, ("lake", "none"): {"e": []},
             ("query", "q"): {"c": ["blue", "green", "black"]}}
VERSION_2 = {key: value for key, value in VERSION_1.items() if key[1] != "gone"} | {
    ("lake", "fruits"): {"c": ["apple", "pear", "quince"]}, ("lake", "shapes"): {"s": ["round"]}}
METHODS = {"hash": {"n_features": 64}, "count": {}, "tfidf": {}, "encoder": {"sample_size": 3}}
FULL = full_params("hash", METHODS["hash"])


def anew(lake, method):
    return dense_vectors(*lake, METHODS[method]) if method == "encoder" else sparse_vectors(*lake, method, METHODS[method])


def prints(lake):
    return {tuple(r)[:2]: r["print"] for r in table_prints(*lake).collect()}


def test_prints_follow_content_and_not_order(spark):
    cells, meta = lake_of(spark, VERSION_1)
    base = prints((cells, meta))
    assert set(base) == set(VERSION_1)
    assert base == prints((cells.orderBy(F.rand(3)).repartition(5), meta.repartition(3)))
    assert {key for key, value in prints(lake_of(spark, VERSION_2)).items() if base.get(key) != value} == {
        ("lake", "fruits"), ("lake", "shapes")}
    for change in ({"c": ["red", None, "blue"], "n": ["1", "2", "3"]}, {"c": ["red", "blue", None], "m": ["1", "2", "3"]},
                   {"c": ["red", "blue"], "n": ["1", "2"]}, {"n": ["1", "2", "3"], "c": ["red", "blue", None]}):
        assert prints(lake_of(spark, VERSION_1 | {("lake", "colors"): change}))[("lake", "colors")] != base[("lake", "colors")]


@pytest.mark.parametrize("method", METHODS)
def test_refreshed_vectors_equal_new_ones(spark, tmp_path, method):
    store = VectorStore(spark, str(tmp_path))
    built = []
    for version in (VERSION_1, VERSION_1, VERSION_2, VERSION_2, VERSION_1):
        lake = lake_of(spark, version)
        got, n_built = refreshed_vectors(store, "same name", method, METHODS[method], *lake)
        built.append(n_built)
        expected = anew(lake, method)
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got, *sorted(got.columns)) == rows(expected, *sorted(got.columns))
    # counted terms or their weights changed, so all tables have new vectors
    assert built == ([5, 0, 5, 0, 5] if method in ("count", "tfidf") else [5, 0, 2, 0, 2])


def test_a_table_that_leaves_needs_no_work(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path))
    refreshed_vectors(store, "one", "hash", METHODS["hash"], *lake_of(spark, VERSION_1))
    less = lake_of(spark, {key: value for key, value in VERSION_1.items() if key[1] != "gone"})
    got, n_built = refreshed_vectors(store, "one", "hash", METHODS["hash"], *less)
    assert n_built == 0 and got.filter("table_name = 'gone'").count() == 0 and got.count() > 0


def test_many_versions_are_written_together(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path), max_versions=2)
    for number in range(4):
        lake = lake_of(spark, VERSION_1 | {("lake", f"new{i}"): {"c": [f"word{i}"]} for i in range(number)})
        got, n_built = refreshed_vectors(store, "one", "hash", METHODS["hash"], *lake)
        assert n_built == (5 if number == 0 else 1)
        assert rows(got, *got.columns) == rows(anew(lake, "hash"), *got.columns)
    assert store.table_versions("one", "hash", FULL).select("version").distinct().count() == 2


def test_a_refresh_that_stops_leaves_the_last_one(spark, tmp_path):
    class Broken(VectorStore):
        def _declare(self, *args, **named):
            raise OSError("full")

    first = lake_of(spark, VERSION_1)
    refreshed_vectors(VectorStore(spark, str(tmp_path)), "one", "hash", METHODS["hash"], *first)
    with pytest.raises(OSError):
        refreshed_vectors(Broken(spark, str(tmp_path)), "one", "hash", METHODS["hash"], *lake_of(spark, VERSION_2))
    assert refreshed_vectors(VectorStore(spark, str(tmp_path)), "one", "hash", METHODS["hash"], *first)[1] == 0


def test_an_empty_lake(spark, tmp_path):
    cells, meta = lake_of(spark, VERSION_1)
    store = VectorStore(spark, str(tmp_path))
    for _ in range(2):
        got, n_built = refreshed_vectors(store, "one", "hash", METHODS["hash"], cells.limit(0), meta.limit(0))
        assert n_built == 0 and got.count() == 0
