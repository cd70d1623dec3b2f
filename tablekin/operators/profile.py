"""Sizes, missing cells and column classes of a lake.

Everything is computed from one record per column (``column_stats`` or ``column_types``),
so the cells are aggregated once and only small frames are shuffled after that.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekin.schema import LAKE, QUERY, TABLE


def without_duplicates(columns: DataFrame) -> DataFrame:
    """Drops lake tables that are also query tables."""
    queries = columns.filter(F.col("side") == QUERY).select("table_name").distinct()
    lake = columns.filter(F.col("side") == LAKE).join(queries, "table_name", "left_anti")
    return lake.select(*columns.columns).unionByName(columns.filter(F.col("side") == QUERY))


def table_sizes(columns: DataFrame) -> DataFrame:
    """Rows, columns and missing cells per table; every column has a cell for each row."""
    return columns.groupBy(*TABLE).agg(
        F.max("n_rows").alias("n_rows"), F.count("*").alias("n_columns"),
        F.sum(F.col("n_rows") - F.col("n_values")).alias("n_missing"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100 / whole, 2)).otherwise(F.lit(0.0))


def profile_sizes(tables: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files, rows, columns and cells, per side by default; ``[]`` gives the combined row."""
    return tables.groupBy(*(["side"] if keys is None else keys)).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("n_columns"), F.lit(0)).alias("total_columns"),
        F.coalesce(F.sum(F.col("n_rows") * F.col("n_columns")), F.lit(0)).alias("total_cells"))


def profile_missing(tables: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Missing cells and their percentage to two places, 0 without cells."""
    sums = tables.groupBy(*(["side"] if keys is None else keys)).agg(
        F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.col("n_rows") * F.col("n_columns")), F.lit(0)).alias("_cells"))
    return sums.withColumn("missing_pct", percent(F.col("missing"), F.col("_cells"))).drop("_cells")


def profile_averages(tables: DataFrame) -> DataFrame:
    """Mean rows and columns per file, halves to even."""
    return tables.groupBy("side").agg(
        F.bround(F.avg("n_rows")).cast("bigint").alias("avg_rows"),
        F.bround(F.avg("n_columns")).cast("bigint").alias("avg_columns"))


def profile_column_types(types: DataFrame) -> DataFrame:
    """Columns per class and their share within the side."""
    counted = types.groupBy("side", "data_type").agg(F.count("*").alias("n_columns"))
    total = F.sum("n_columns").over(Window.partitionBy("side"))
    return counted.withColumn("pct", percent(F.col("n_columns"), total))


def profile_unique_columns(columns: DataFrame) -> DataFrame:
    """Distinct column names per side and, as side ``combined``, over both, in one pass.

    Without columns there are no rows.
    """
    counted = columns.select("side", "col_name").groupingSets([["side"], []], "side").agg(
        F.count_distinct("col_name").alias("unique_columns"), F.grouping("side").alias("_all"))
    return counted.select(
        F.when(F.col("_all") == 1, "combined").otherwise(F.col("side")).alias("side"),
        "unique_columns")


def profile_combined(columns: DataFrame) -> DataFrame:
    """One row of totals over both sides; ``columns`` is read twice, so stored or cut."""
    sizes = table_sizes(columns).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("n_columns"), F.lit(0)).alias("total_columns"),
        F.coalesce(F.sum(F.col("n_rows") * F.col("n_columns")), F.lit(0)).alias("total_cells"),
        F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing"))
    unique = columns.select("col_name").distinct().agg(F.count("*").alias("unique_columns"))
    return sizes.withColumn("missing_pct", percent(F.col("missing"), F.col("total_cells"))).crossJoin(unique)
