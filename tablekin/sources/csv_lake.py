"""Lakes of CSV files, one table per file, each with its own header."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.functions.frames import cut, join_small
from tablekin.functions.headers import unique_names
from tablekin.functions.values import null_if_missing, strip_csv
from tablekin.schema import COLUMN
from tablekin.sources.csv_records import read_records


def _table_name(path) -> F.Column:
    return strip_csv(F.url_decode(F.element_at(F.split(
        F.regexp_replace(path, r"\+", "%2B"), "/"), -1)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _header_names(headers: pd.Series) -> pd.Series:
    return headers.map(lambda names: unique_names(list(names)))


def _headers(records: DataFrame, unreadable: DataFrame) -> DataFrame:
    """``path, names, first_block`` of all readable files: the fields of the first record."""
    first = records.filter(F.col("at") == 0).groupBy("path").agg(
        F.min_by("fields", "block").alias("header"), F.min("block").alias("first_block"))
    return cut(first.join(unreadable, "path", "left_anti").select("path", _header_names("header").alias("names"), "first_block"))


def _numbered(rows: DataFrame, is_data) -> DataFrame:
    """The data rows with ``row_id``, which counts them from 0 in each file.

    A block's rows start at the number of data rows in the blocks before it. Within a block a row's place is its
    record's, less one for a header; only blocks that hold skipped rows are numbered by a window over the block.
    """
    header = (F.col("block") == F.col("first_block")) & (F.col("at") == 0)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(rows.groupBy("path", "block").agg(
        F.count_if(is_data).alias("n"), F.count_if(~is_data & ~header).alias("skipped"),
        F.count_if(header).alias("headers")).select(
            "path", "block", "skipped", "headers", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed")))
    counted = blocks.agg(F.count("*").alias("blocks"), F.count_if(F.col("skipped") > 0).alias("uneven")).first()
    placed = join_small(rows.filter(is_data), blocks, ["path", "block"], counted["blocks"], spread=["at"])
    even = placed.withColumn("row_id", F.col("passed") + F.col("at") - F.col("headers"))
    if not counted["uneven"]:
        return even
    in_block = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    uneven = placed.filter(F.col("skipped") > 0).withColumn("row_id", F.col("passed") + in_block)
    return even.filter(F.col("skipped") == 0).unionByName(uneven)


def parse_csv_lake(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed cells of all ``*.csv`` of a folder, with each header as row -1.

    Files are cut into records in parallel, a large one by many tasks (see ``csv_records``), and parsed once.
    The header is the first record, line breaks in quotes included; fields that a short row lacks are missing, rows with more
    fields than the header are skipped. The result does not depend on how Spark splits the files.
    """
    records, unreadable = read_records(spark, folder)
    headers = _headers(records, unreadable)
    rows = join_small(records, headers, ["path"], headers.count(), spread=["block", "at"])
    is_data = ~((F.col("block") == F.col("first_block")) & (F.col("at") == 0)) & (F.size("fields") <= F.size("names"))
    cells = _numbered(rows, is_data).select(
        _table_name(F.col("path")).alias("table_name"), "row_id", "fields",
        F.posexplode("names").alias("col_pos", "col_name"),
    ).select("table_name", "col_pos", "col_name", "row_id",
             null_if_missing(F.get("fields", "col_pos")).alias("value"))
    return cells.unionByName(headers.select(
        _table_name(F.col("path")).alias("table_name"), F.posexplode("names").alias("col_pos", "col_name"),
        F.lit(-1).cast("long").alias("row_id"), F.lit(None).cast("string").alias("value")))


def split_parsed(parsed: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``columns_meta`` of parsed files."""
    tagged = parsed.withColumn("side", F.lit(side))
    cells = tagged.filter(F.col("row_id") >= 0).select(*COLUMN, "col_name", "row_id", "value")
    meta = tagged.filter(F.col("row_id") < 0).select(
        *COLUMN, "col_name", F.lit("text").alias("source_type"))
    return cells, meta


def read_csv_lake(spark: SparkSession, folder: str, side: str) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``columns_meta`` of a folder of CSV files.

    Records are kept in the checkpoint folder as long as the frames are; ``store_lake`` keeps cells.
    """
    return split_parsed(parse_csv_lake(spark, folder), side)
