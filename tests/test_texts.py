from pyspark.sql import functions as F
import pytest

from tablekin.operators import sampling, texts
from tablekin.schema import COLUMN
from tests.helpers import lake_of, rows


@pytest.fixture(scope="module")
def lake(spark):
    return lake_of(spark, {
        ("lake", "t"): {"a": ["x", "x", None, "y"], "b": [None] * 4, "c": ["1", " ", "2", None]},
        ("lake", "norows"): {"a": []}})


def by_unit(df):
    return {r["unit_id"]: r["text"] for r in df.collect()}


def test_column_texts(lake):
    got = {(r["table_name"], r["col_pos"]): r["text"]
           for r in texts.column_texts(*lake, 10, include_names=True).collect()}
    assert got[("t", 1)] == "b" and got[("norows", 0)] == "a"
    assert sorted(got[("t", 0)].split()) == ["a", "x", "x", "y"] and got[("t", 0)][0] == "a"
    plain = {(r["table_name"], r["col_pos"]): r["text"]
             for r in texts.column_texts(*lake, 10).collect()}
    assert plain[("t", 1)] == "" and sorted(plain[("t", 0)].split()) == ["x", "x", "y"]


def test_encoder_texts(lake):
    full = by_unit(texts.encoder_column_texts(*lake, 10))
    assert full[1] == "Column: b" and set(full) == {0, 1, 2}
    assert full[0] in ("Column: a. Values: x, y", "Column: a. Values: y, x")
    assert by_unit(texts.encoder_column_texts(*lake, 10, names_only=True)) == {
        0: "Column: a", 1: "Column: b", 2: "Column: c"}
    plain = by_unit(texts.encoder_column_texts(*lake, 10, include_names=False, deduplicate=False))
    assert set(plain) == {0, 2} and sorted(plain[0].split(", ")) == ["x", "x", "y"]
    assert by_unit(texts.encoder_column_texts(*lake, 10, max_chars=5))[1] == "Colum"


def test_row_and_header_texts(lake):
    cells, meta = lake
    assert by_unit(texts.row_texts(cells, 2, 10)) == {
        0: "a: x, c: 1", 1: "a: x", 2: "c: 2", 3: "a: y"}
    assert by_unit(texts.row_texts(cells, 2, 10, include_names=False))[0] == "x, 1"
    assert len(by_unit(texts.row_texts(cells, 2, 2))) == 2
    assert rows(texts.header_texts(cells, meta), "table_name", "text") == [("t", "a, b, c")]


def test_samples_do_not_depend_on_partitions_or_skew(spark):
    cells, _ = lake_of(spark, {
        ("lake", "big"): {"c": list(range(5000))}, ("lake", "small"): {"c": [1, 2, None]}})
    few = sampling.column_sample(cells.repartition(1), 50)
    many = sampling.column_sample(cells.repartition(13), 50)
    assert rows(few, *few.columns) == rows(many, *few.columns)
    assert few.count() == 52
    assert rows(sampling.row_sample(cells, 2), "table_name", "rn") == [
        ("big", 1), ("big", 2), ("small", 1), ("small", 2)]
    first = sampling.first_rows(cells, 3, 2).filter("table_name = 'big'")
    assert rows(first, "row_id") == [(0,), (1,), (2,)]


def test_salted_join_equals_broadcast(spark, monkeypatch):
    from tablekin.functions import frames
    big = spark.createDataFrame([("k" if i % 3 else f"k{i}", i) for i in range(300)], "k string, v int")
    small = spark.createDataFrame([("k", 1), ("k0", 2), ("none", 3)], "k string, w int")
    plain = frames.join_small(big, small, ["k"], 3, ["v"])
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 0)
    salted = frames.join_small(big, small, ["k"], 3, ["v"])
    assert rows(plain, "k", "v", "w") == rows(salted, "k", "v", "w") and plain.count() == 201


@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_other_salted_joins(spark, monkeypatch, how):
    from tablekin.functions import frames
    big = spark.createDataFrame([("k" if i % 3 else f"k{i}", i) for i in range(60)], "k string, v int")
    small = spark.createDataFrame([("k", 1), ("k0", 2)], "k string, w int")
    plain = frames.join_small(big, small, ["k"], 2, ["v"], how)
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 0)
    salted = frames.join_small(big, small, ["k"], 2, ["v"], how)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))
    assert plain.count() == (60 if how == "left" else 41)


def test_salted_sample_equals_plain(spark):
    from tablekin.functions.frames import first_per_group
    cells, _ = lake_of(spark, {
        ("lake", "big"): {"c": list(range(900)), "d": ["x"] * 900}, ("lake", "small"): {"c": [1, None]}})
    order = [F.md5(F.concat("col_name", F.col("row_id").cast("string"))), F.col("row_id")]
    plain = first_per_group(cells.filter("value is not null"), COLUMN, order, 70, ["row_id"], salts=1).select(
        *COLUMN, "col_name", "rn", "value")
    salted = sampling.column_sample(cells, 70)
    assert rows(plain, *plain.columns) == rows(salted, *plain.columns) and plain.count() == 141
