"""Columns, rows and headers written as texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.functions.values import BLANK_PATTERN
from tablekin.operators.sampling import (
    cells_of_row_sample,
    column_sample,
    distinct_sample,
)
from tablekin.schema import COLUMN, TABLE

# How columns are written for an encoder.
NAME_HEAD, VALUES_HEAD = "Column: ", ". Values: "
# 5 characters for each of the 512 tokens an encoder takes when it names no limit of its own
ENCODER_CHARS = 2560


def _joined(order: str, value: Column, separator: str) -> Column:
    """Aggregate: the values of a group joined in order; groups are samples, so bounded."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value.alias("text"))))
    return F.array_join(F.transform(ordered, lambda item: item["text"]), separator)


def sample_texts(sample: DataFrame, separator: str) -> DataFrame:
    return sample.groupBy(*COLUMN).agg(_joined("rn", F.col("value"), separator).alias("text"))


def column_texts(cells: DataFrame, columns_meta: DataFrame, n: int = 1000,
                 include_names: bool = False) -> DataFrame:
    """Sampled values joined by spaces, one text per column; empty columns give ''."""
    texts = sample_texts(column_sample(cells, n), " ")
    text = F.coalesce("text", F.lit(""))
    if include_names:
        text = F.when(text == "", F.col("col_name")).otherwise(
            F.concat_ws(" ", "col_name", text))
    return columns_meta.join(texts, COLUMN, "left").select(*COLUMN, "col_name", text.alias("text"))


def nonempty_tables(cells: DataFrame) -> DataFrame:
    return cells.select(*TABLE).distinct()


def encoder_column_texts(cells: DataFrame, columns_meta: DataFrame, n: int = 20,
                         include_names: bool = True, names_only: bool = False,
                         deduplicate: bool = True, max_chars: int = ENCODER_CHARS) -> DataFrame:
    """One text per column for a sentence encoder.

    ``Column: c. Values: a, b``, or ``Column: c`` for columns without values or if only
    names are wanted; without names just ``a, b``, and columns without values are left out.
    Tables without rows give no text.
    """
    columns = columns_meta.join(nonempty_tables(cells), TABLE, "left_semi")
    name = F.concat(F.lit(NAME_HEAD), "col_name")
    if include_names and names_only:
        units = columns.withColumn("text", name)
    else:
        sample = distinct_sample(cells, n) if deduplicate else column_sample(cells, n)
        units = columns.join(sample_texts(sample, ", "), COLUMN,
                             "left" if include_names else "inner")
        if include_names:
            units = units.withColumn("text", F.when(F.col("text").isNull(), name).otherwise(
                F.concat(name, F.lit(VALUES_HEAD), "text")))
    return units.select(*TABLE, F.col("col_pos").cast("bigint").alias("unit_id"),
                        F.substring("text", 1, max_chars).alias("text"))


def row_texts(cells: DataFrame, n_tables: int, n: int = 20, include_names: bool = True,
              max_chars: int = ENCODER_CHARS) -> DataFrame:
    """One text per sampled row: ``c: v, c: v`` or ``v, v``; rows without values give none."""
    filled = cells_of_row_sample(cells, n, n_tables).filter(
        F.col("value").isNotNull() & ~F.col("value").rlike(BLANK_PATTERN))
    item = F.concat("col_name", F.lit(": "), "value") if include_names else F.col("value")
    return (
        filled.groupBy(*TABLE, F.col("row_id").alias("unit_id"))
        .agg(_joined("col_pos", item, ", ").alias("text"))
        .withColumn("text", F.substring("text", 1, max_chars))
    )


def header_texts(cells: DataFrame, columns_meta: DataFrame,
                 max_chars: int = ENCODER_CHARS) -> DataFrame:
    """``c1, c2, ...`` as the only text of each table that has rows."""
    return (
        columns_meta.join(nonempty_tables(cells), TABLE, "left_semi")
        .groupBy(*TABLE)
        .agg(_joined("col_pos", F.col("col_name"), ", ").alias("text"))
        .select(*TABLE, F.lit(0).cast("bigint").alias("unit_id"),
                F.substring("text", 1, max_chars).alias("text"))
    )
