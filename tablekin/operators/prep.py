"""Preparing a lake: only tables in the ground truth, short tables, a sample of queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.operators.sampling import first_rows
from tablekin.operators.search import sample_queries
from tablekin.schema import LAKE, TABLE


def select_tables(frame: DataFrame, names: DataFrame | None) -> DataFrame:
    """Rows of the named tables (``table_name``, with or without .csv); None keeps all."""
    if names is None:
        return frame
    wanted = names.select(F.regexp_replace("table_name", r"\.csv", "").alias("table_name"))
    return frame.join(wanted.distinct(), "table_name", "left_semi").select(*frame.columns)


def keep_referenced(tables: DataFrame, gt: DataFrame) -> DataFrame:
    """Drops lake tables the ground truth does not name; query tables stay."""
    named = gt.select(F.col("cand_table").alias("table_name")).unionByName(
        gt.select(F.col("query_table").alias("table_name"))).distinct()
    lake = tables.filter(F.col("side") == LAKE).join(named, "table_name", "left_semi")
    return lake.select(*tables.columns).unionByName(tables.filter(F.col("side") != LAKE))


def keep_present(gt: DataFrame, tables: DataFrame) -> DataFrame:
    """Drops ground-truth edges to tables that are neither in the lake nor queries."""
    present = tables.select(F.col("table_name").alias("cand_table")).distinct()
    return gt.join(present, "cand_table", "left_semi").select("query_table", "cand_table")


def keep_queries(gt: DataFrame, names: DataFrame) -> DataFrame:
    """Ground truth of the query tables that are there (``table_name``)."""
    there = names.select(F.col("table_name").alias("query_table")).distinct()
    return gt.join(there, "query_table", "left_semi").select("query_table", "cand_table")


def add_self(gt: DataFrame) -> DataFrame:
    """Makes every query its own candidate."""
    queries = gt.select("query_table", F.col("query_table").alias("cand_table"))
    return gt.unionByName(queries).distinct()


def truncate_tables(cells: DataFrame, n: int, n_tables: int) -> DataFrame:
    """The first ``n`` rows of each table."""
    return first_rows(cells, n, n_tables)


def sample_query_tables(tables: DataFrame, n: int) -> DataFrame:
    """n query tables, in md5 order of their names."""
    queries = tables.filter(F.col("side") == "query").select(
        F.col("table_name").alias("query_table")).distinct()
    return sample_queries(queries, n).withColumnRenamed("query_table", "table_name")


def table_names(columns_meta: DataFrame) -> DataFrame:
    return columns_meta.select(*TABLE).distinct()
