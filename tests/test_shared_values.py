"""Values that pairs share, by lists and by pairs, against plain sets; the filter of keys."""

import random

import pytest
from pyspark.sql import functions as F

from tablekin.functions.key_filter import only_known
from tablekin.operators.overlap import value_counts
from tablekin.schema import DATA_TYPES

SETS = "side string, table_name string, value_key string, types int"
COUNTS = ["common", *[f"common_{name}" for name in DATA_TYPES]]


def _lake(seed: int):
    """Sets of 9 queries and 12 candidates (two of them queries) with rare, frequent and ubiquitous values."""
    rng = random.Random(seed)
    sets = {}
    for side, table in [("query", f"q{i}") for i in range(9)] + [("lake", f"c{i}") for i in range(12)]:
        keys = {f"s:r{rng.randrange(60)}" for _ in range(rng.randrange(25))}
        keys |= {f"s:f{k}" for k in range(5) if rng.random() < 0.6} | {"s:all"}
        sets[side, table] = {key: rng.randrange(1, 16) for key in keys}
    sets["lake", "c11"] = {}
    names = [("lake", f"c{i}") for i in range(12)] + [("query", "q0"), ("query", "q1")]
    pairs = {(f"q{rng.randrange(9)}", name, side) for side, name in rng.choices(names, k=50)}
    # one query asks for everything
    pairs |= {("q2", name, side) for side, name in names}
    return sets, sorted(pairs)


@pytest.mark.parametrize("list_tables", [0, 3, 8, 1000])
def test_shared_values(spark, list_tables):
    sets, pairs = _lake(list_tables)
    frame = spark.createDataFrame(
        [(*table, key, types) for table, keys in sets.items() for key, types in keys.items()], SETS)
    resolved = spark.createDataFrame(pairs, "query_table string, cand_table string, location string")
    got = {(r["query_table"], r["cand_table"]): (r["query_n"], r["cand_n"], *[r[c] for c in COUNTS])
           for r in value_counts(resolved, frame, len(pairs), list_tables).collect()}
    expected = {}
    for query, cand, side in pairs:
        left, right = sets["query", query], sets[side, cand]
        both = [left[key] & right[key] for key in left.keys() & right.keys()]
        expected[query, cand] = (len(left), len(right), len(both),
                                 *[sum(1 for t in both if t >> i & 1) for i in range(len(DATA_TYPES))])
    assert got == expected
    assert sum(counts[2] for counts in expected.values()) > 200


def test_no_values_and_no_pairs(spark):
    nothing = spark.createDataFrame([], SETS)
    resolved = spark.createDataFrame([("q", "c", "lake")],
                                     "query_table string, cand_table string, location string")
    row = value_counts(resolved, nothing, 1).first()
    assert (row["query_n"], row["cand_n"], row["common"]) == (0, 0, 0)
    assert value_counts(resolved.limit(0), nothing, 0).count() == 0


def test_broadcast_pairs_or_salted_joins(spark, monkeypatch):
    sets, pairs = _lake(5)
    frame = spark.createDataFrame(
        [(*table, key, types) for table, keys in sets.items() for key, types in keys.items()], SETS)
    resolved = spark.createDataFrame(pairs, "query_table string, cand_table string, location string")

    def counted() -> list[tuple]:
        return sorted(tuple(r) for r in value_counts(resolved, frame, len(pairs), 8).collect())

    before = counted()
    monkeypatch.setattr("tablekin.functions.frames.BROADCAST_ROWS", 0)
    assert counted() == before


def test_filter_keeps_known_keys(spark):
    known = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    rows = spark.range(50_000).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("n"))
    rows = rows.unionByName(rows.limit(1).select(F.lit(None).cast("string").alias("key"), "n"))
    left = only_known(rows, "key", known, 5000)
    assert left.columns == ["key", "n"]
    assert left.filter("n < 5000").select("n").distinct().count() == 5000
    assert left.filter("n >= 5000").count() < 45_000 * 0.06
    assert left.filter("key is null").count() == 0
    assert only_known(rows, "key", known, 5000, max_words=10) is rows
    assert only_known(rows, "key", known.limit(0), 0).count() == 0
