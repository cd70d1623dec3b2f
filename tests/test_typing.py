import pytest
from pyspark.sql import functions as F

from tablekin.functions.values import as_double, as_long, value_class
from tablekin.operators.typing import column_types
from tests.helpers import lake_of

COLUMNS = {
    "plain": (["1", "2"], "integer"),
    "zeros": (["007", "008"], "integer"),
    "gap": (["1", None, "3"], "float"),
    "exponent": (["1e5", "2"], "float"),
    "bools": (["True", "False"], "string"),
    "dates": (["2020-01-01", "2020-01-02"], "string"),
    "dates_gap": (["2020-01-01", None], "other"),
    "mixed": (["1", "x"], "string"),
    "mixed_gap": (["1", None, "x"], "other"),
    "missing": (["NA", "null", ""], "float"),
    "no_rows": ([], "string"),
    "huge": (["99999999999999999999", "1"], "string"),
    "unsigned": (["18446744073709551615", "1"], "integer"),
    "suffixed": (["1d", "2f"], "string"),
    "words_gap": (["ab", None, "cd"], "string"),
    "blank_gap": ([" ", None, "  "], "other"),
    "blank_numbers_gap": (["1", " ", None, "2.5"], "float"),
    "infinite": (["inf", "-Infinity"], "float"),
    "too_big": (["1e400", "1"], "string"),
    "integers_mostly": (["1"] * 8 + [None, "x"], "integer"),
}


def test_each_rule(spark):
    cells, meta = lake_of(spark, {("lake", name): {"c": values}
                                  for name, (values, _) in COLUMNS.items()})
    got = {r["table_name"]: r["data_type"] for r in column_types(cells, meta).collect()}
    assert got == {name: expected for name, (_, expected) in COLUMNS.items()}


def test_typed_sources(spark):
    cells, meta = lake_of(spark, {("lake", "t"): {"i": ["1", "2"], "g": ["1", None], "f": ["1", "2"]}})
    typed = meta.withColumn("source_type", F.when(F.col("col_name") == "f", "float").otherwise(
        "integer"))
    got = {r["col_name"]: r["data_type"] for r in column_types(cells, typed).collect()}
    assert got == {"i": "integer", "g": "float", "f": "float"}


@pytest.mark.parametrize(("value", "expected"), [
    (None, "null"), (" ", "null"), ("+12", "integer"), (" 3 ", "integer"), ("-1.5", "float"),
    ("1.", "other"), ("é", "string"), ("a1", "string"), ("2020-01-01", "other"), ("%", "other")])
def test_value_class(spark, value, expected):
    frame = spark.createDataFrame([(value,)], "v string")
    assert frame.select(value_class(F.col("v"))).first()[0] == expected


def test_numbers(spark):
    frame = spark.createDataFrame(
        [("1",), ("1d",), ("1e400",), ("99999999999999999999",), (".5",), ("-inf",)], "v string")
    got = [tuple(r) for r in frame.select(as_long(F.col("v")), as_double(F.col("v"))).collect()]
    assert got == [(1, 1.0), (None, None), (None, None), (None, None), (None, 0.5),
                   (None, float("-inf"))]
