"""Ground truth: which candidate tables belong to which query table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.functions.values import strip_csv


def ground_truth_edges(lists: DataFrame, query: str = "query_table",
                       candidates: str = "candidates") -> DataFrame:
    """One ``query_table, cand_table`` row per listed candidate, each once, without .csv.

    A query with an empty list keeps one row with a null candidate.
    """
    edges = lists.select(F.col(query).alias("query_table"),
                         F.explode_outer(candidates).alias("cand_table"))
    return edges.select(strip_csv(F.col("query_table")).alias("query_table"),
                        strip_csv(F.col("cand_table")).alias("cand_table")).distinct()


def read_ground_truth(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Reads edges, lists or maps from Parquet or JSON.

    Accepted columns: ``query_table, cand_table`` (one edge per row), ``query_table,
    candidates`` (array), or a single map from query to candidates.
    """
    frame = spark.read.format(fmt).load(path)
    if {"query_table", "cand_table"} <= set(frame.columns):
        edges = frame.groupBy("query_table", "cand_table").agg(F.lit(1)).select(
            "query_table", F.array("cand_table").alias("candidates"))
        return ground_truth_edges(edges)
    if {"query_table", "candidates"} <= set(frame.columns):
        return ground_truth_edges(frame)
    only = frame.schema.fields[0]
    if len(frame.columns) == 1 and isinstance(only.dataType, T.MapType):
        return ground_truth_edges(
            frame.select(F.explode(only.name).alias("query_table", "candidates")))
    raise ValueError(f"no ground truth columns in {frame.columns}")
