"""What a task holds does not grow with the tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from registered import spark_queries
from tablekin.functions.frames import first_per_group
from tablekin.operators import pruned, sampling
from tablekin.schema import COLUMN
from tests.helpers import rows


class Tables:
    """A lake of plain frames."""

    def __init__(self, **frames):
        self.lake, self.frames = self, frames

    def table(self, name):
        return self.frames[name]


@pytest.mark.parametrize("name, key", [("tokens_word", "token"), ("tokens_hash", "token"), ("stopword_filter", "token"),
                                       ("word_ngrams", "term")])
def test_texts_are_dealt_by_their_size(spark, monkeypatch, name, key):
    texts = [(i % 50, "Some words, the words of some text " + "x" * (i % 5)) for i in range(200)]
    tables = Tables(documents=spark.createDataFrame(texts, "doc_id long, text string"))
    plain = rows(spark_queries.QUERIES[name](tables), "doc_id", key, "n")
    monkeypatch.setattr(spark_queries, "PART_BYTES", 100)
    assert spark_queries._documents(tables).rdd.getNumPartitions() >= 70
    assert rows(spark_queries.QUERIES[name](tables), "doc_id", key, "n") == plain


CELLS = "side string, table_name string, col_pos int, col_name string, row_id long, value string"


@pytest.fixture(scope="module")
def cells(spark):
    """Two large columns, one of a table without a name, a small one, and rows without a number."""
    made = [("lake", None if c else "t", c, f"c{c}", None if r % 400 == 0 else r % 5000, f"v{r % 3000}")
            for c in range(2) for r in range(6000)]
    return spark.createDataFrame([*made, ("lake", "u", 0, "d", 1, "x"), ("lake", "u", 0, "d", 2, None)], CELLS)


def test_samples_sort_few_cells(cells):
    kept = sampling.sample_front(cells, 40)
    assert 81 <= kept.count() < 200 and kept.filter("table_name = 'u'").count() == 1
    order = [F.md5(F.concat("col_name", F.col("row_id").cast("string"))), F.col("row_id")]
    plain = first_per_group(cells.filter("value is not null"), COLUMN, order, 40, ["row_id"], salts=1)
    key = F.coalesce("table_name", F.lit("")).alias("t")
    number = F.coalesce("row_id", F.lit(-1)).alias("r")
    assert rows(plain.select(key, "col_pos", number, "rn"), "t", "col_pos", "r", "rn") == rows(
        first_per_group(kept, COLUMN, order, 40, ["row_id"]).select(key, "col_pos", number, "rn"), "t", "col_pos", "r", "rn")


def test_distinct_samples_keep_enough_values(cells):
    found = sampling.distinct_sample(cells, 20).select(F.coalesce("table_name", F.lit("")).alias("t"), "col_pos", "rn", "value")
    texts = sorted((f"v{r}" for r in range(3000)), key=lambda v: hashlib.md5(v.encode()).hexdigest())[:20]
    assert rows(found, "t", "col_pos", "rn", "value") == sorted(
        [*[("t", 0, i + 1, v) for i, v in enumerate(texts)], *[("", 1, i + 1, v) for i, v in enumerate(texts)], ("u", 0, 1, "x")])


def test_parts_of_candidates_do_not_grow_with_them(spark):
    """Each block of queries runs a task a part, whose results all go to the driver."""
    parts = []
    for n in (5_000, 100_000):
        vectors = spark.range(n).select(F.col("id").cast("string").alias("cand_table"), F.array(
            *[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("vec"))
        kept = pruned.laid_out(vectors, ["vec"], n, n).rows
        assert kept.count() == n
        parts.append(kept.rdd.getNumPartitions())
    assert parts[0] == parts[1] <= 4 * spark.sparkContext.defaultParallelism


def test_row_ids_are_counted_by_words(spark, monkeypatch):
    """Repeated ids count once, whatever their distance and in each column."""
    cells = spark.createDataFrame([("lake", "t", c, f"c{c}", r, None if r == 64 else "1.5") for c in range(2)
                                   for r in (0, 63, 63, 64, 1 << 41, (1 << 41) + 63)], CELLS)
    meta = spark.createDataFrame([("lake", "t", 0, "c0", "float"), ("lake", "t", 1, "c1", "text")],
                                 "side string, table_name string, col_pos int, col_name string, source_type string")
    monkeypatch.setattr(spark_queries, "_parquet_lake", lambda w: (cells, meta))
    got = spark_queries.parquet_lake_cells(None)
    assert rows(got, *got.columns[1:]) == [(0, "c0", "float", 6, 5, 5, 1, 7.5, None, None), (1, "c1", "text", 6, 5, 5, 1, None, "1.5", "1.5")]
    # equal values meet before they are dealt, without a row for each kind of count
    assert "Expand" not in got._jdf.queryExecution().toString()
