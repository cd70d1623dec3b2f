"""Reproducible samples of columns, distinct values and rows.

Rows are ordered by an md5 of what identifies them, so a sample is the same on every
engine, partitioning and rerun.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekin.functions.frames import cut, first_per_group, join_small
from tablekin.schema import COLUMN, TABLE

DIGITS = 3  # of an md5, by which rows are counted before a sample is taken


def front(rows: DataFrame, keys: list[str], md5: Column, n: int, spread: list[str], distinct: bool = False) -> DataFrame:
    """``rows`` without nearly all of those that come after the first ``n`` of their group in order of ``md5``.

    Rows are counted by group and the first digits of the md5. A group keeps the digits up to those that make
    its n rows full (``distinct``: n different md5s), so no row of its sample is lost, and what is sorted later hardly
    grows with the group. Groups of at most n rows are kept as they are.
    """
    digits = F.coalesce(F.substring(md5, 1, DIGITS), F.lit(""))  # nulls come first
    counted = rows.groupBy(*keys, digits.alias("_digits")).agg((F.lit(1) if distinct else F.count("*")).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
    # a group's null is a value like others, which a join by a struct respects
    last = cut(counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).groupBy(
        F.struct(*keys).alias("_group")).agg(
        F.max(F.when(F.col("_before") < n, F.col("_digits"))).alias("_last"), F.max("_digits").alias("_most"))
        .filter(F.col("_last") < F.col("_most")).drop("_most"))
    groups = last.count()
    if not groups:
        return rows
    known = join_small(rows.withColumn("_group", F.struct(*keys)), last, ["_group"], groups, spread=spread, how="left")
    return known.filter(F.col("_last").isNull() | (digits <= F.col("_last"))).select(*rows.columns)


def _cell_key() -> Column:
    return F.md5(F.concat("col_name", F.col("row_id").cast("string")))


def sample_front(cells: DataFrame, n: int) -> DataFrame:
    """Cells among which are all those that ``column_sample`` takes, for any sample of up to ``n``."""
    return front(cells.filter(F.col("value").isNotNull()), COLUMN, _cell_key(), n, spread=["row_id"])


def column_sample(cells: DataFrame, n: int = 1000) -> DataFrame:
    """min(n, non-missing) cells of each column, without replacement."""
    order = [_cell_key(), F.col("row_id")]
    return first_per_group(sample_front(cells, n), COLUMN, order, n, spread=["row_id"]).select(
        *COLUMN, "col_name", "rn", "value"
    )


def distinct_sample(cells: DataFrame, n: int = 20) -> DataFrame:
    """min(n, distinct) different values of each column."""
    found = cells.filter(F.col("value").isNotNull()).select(*COLUMN, "col_name", "value")
    values = front(found, COLUMN, F.md5("value"), n, spread=["value"], distinct=True).distinct()
    order = [F.md5("value"), F.col("value")]
    return first_per_group(values, COLUMN, order, n, spread=["value"]).select(
        *COLUMN, "col_name", "rn", "value"
    )


def _row_key() -> Column:
    return F.md5(F.col("row_id").cast("string"))


def row_ids(cells: DataFrame) -> DataFrame:
    """One record per table row: the cells of the first column."""
    return cells.filter(F.col("col_pos") == 0).select(*TABLE, "row_id")


def row_sample(cells: DataFrame, n: int = 20) -> DataFrame:
    """min(n, rows) rows of each table."""
    order = [_row_key(), F.col("row_id")]
    rows = front(row_ids(cells), TABLE, _row_key(), n, spread=["row_id"])
    return first_per_group(rows, TABLE, order, n, spread=["row_id"]).select(
        *TABLE, "row_id", "rn"
    )


def cells_of_row_sample(cells: DataFrame, n: int, n_tables: int) -> DataFrame:
    """All cells of the sampled rows.

    Only the last sampled row of each table is joined: a row is in the sample if it does not
    come after that one, so the joined side has one record per table, not per row.
    """
    last = row_sample(cells, n).groupBy(*TABLE).agg(
        F.max(F.struct(_row_key().alias("key"), "row_id")).alias("_last")
    )
    joined = join_small(cells, last, TABLE, n_tables, spread=["row_id"])
    here = F.struct(_row_key().alias("key"), "row_id")
    return joined.filter(here <= F.col("_last")).drop("_last")


def first_rows(cells: DataFrame, n: int, n_tables: int) -> DataFrame:
    """All cells of the first ``n`` rows of each table in row order."""
    last = (
        first_per_group(row_ids(cells), TABLE, [F.col("row_id")], n, spread=["row_id"])
        .groupBy(*TABLE)
        .agg(F.max("row_id").alias("_last"))
    )
    joined = join_small(cells, last, TABLE, n_tables, spread=["row_id"])
    return joined.filter(F.col("row_id") <= F.col("_last")).drop("_last")
