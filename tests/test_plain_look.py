"""What shows without a pattern is what the patterns say; few tables need no count of common values."""

import random

from pyspark.sql import functions as F

from tablekin.functions.values import as_double, as_long, float_key, is_uint64, number_text, plain_look, value_class
from tablekin.operators import overlap

VALUES = [
    "0", "-0", "00", "7", "-7", "+7", " 7", "7 ", "007", "12345678901234567890", "-9223372036854775808", "9223372036854775807",
    "9223372036854775808", "0.5", "-0.5", ".5", "5.", "1.2.3", "1.-5", "1.+5", "1.05", "12.00", "-12.30", "123456789012.123456",
    "1.123456789", "0.123456785", "1e5", "1.0E5", "9007199254740993", "9007199254740993.0", "99999999.12345678", "1.", ".", "-", "-.5",
    "inf", "Infinity", "-inf", "+inf", "nan", "I", "ink", "Z", "[", "{", "{x", "a1", "@", "é", "٣", "٣.٣", "2020-01-02", "2020-13-02",
    "20-1-1", "2020-1-1T1", "2020-01-1T", "10000-1-01", " 020-01-02", "1234567-89", "", " ", "\t", "\n1", "1\n", "a\nb", "1a", "1 2", None]


def test_plain_looks_say_what_patterns_say(spark):
    draw = random.Random(5)
    wild = ["".join(draw.choice("0123456789.-+ eaIi") for _ in range(draw.randrange(1, 9))) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in VALUES + wild], "value string").withColumn("look", plain_look(F.col("value")))
    value = F.col("value")
    frame = frame.select(
        "value", "look", value_class(value).alias("own"), as_long(value).isNotNull().alias("whole"), is_uint64(value).alias("unsigned"),
        as_double(value).isNotNull().alias("number"), as_long(value).cast("string").alias("text"),
        float_key(value, F.col("look")).alias("key"), number_text(F.round(as_double(value), 8)).alias("slow_key"))
    found = set()
    for row in frame.collect():
        assert row["key"] == row["slow_key"], row
        if row["look"] is None:
            continue
        found.add(row["look"])
        integer = row["look"] == "integer"
        assert row["own"] == row["look"] and row["whole"] == integer, row
        assert row["unsigned"] == (integer and not row["value"].startswith("-")), row
        assert row["number"] == (row["look"] in ("integer", "float")), row
        assert not integer or row["text"] == row["value"], row
    assert found == {"integer", "float", "string", "other"}


def test_no_count_of_common_values_where_tables_are_few(spark, monkeypatch):
    pairs = spark.createDataFrame([("q", "a", "lake"), ("q", "b", "lake")], "query_table string, cand_table string, location string")
    sets = spark.createDataFrame(
        [(side, table, f"s:{v}", 4) for side, table, low in [("query", "q", 0), ("lake", "a", 3), ("lake", "b", 8)] for v in range(low, 10)],
        "side string, table_name string, value_key string, types int")
    counts = {}
    for list_tables in (64, 2):
        cuts = []
        monkeypatch.setattr(overlap, "cut", lambda frame, cuts=cuts: cuts.append(1) or frame.localCheckpoint())
        rows = overlap.value_counts(pairs, sets, 2, list_tables).collect()
        counts[list_tables] = len(cuts), sorted((r["cand_table"], r["common"]) for r in rows)
    assert counts == {64: (1, [("a", 7), ("b", 2)]), 2: (2, [("a", 7), ("b", 2)])}
