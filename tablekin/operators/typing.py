"""Column classes integer, float, string and other, as a CSV reader would infer them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.functions.values import as_double, as_long, is_uint64, plain_look, value_class
from tablekin.schema import COLUMN

# in percent, so that the comparison stays in integers
VOTE_SHARE = 70
CLASSES = ["integer", "float", "string", "other", "null"]


def value_class_histogram(cells: DataFrame) -> DataFrame:
    """Cells of each class per column."""
    return cells.groupBy(*COLUMN, value_class(F.col("value")).alias("value_class")).agg(
        F.count("*").alias("n"))


def column_stats(cells: DataFrame, columns_meta: DataFrame) -> DataFrame:
    """Rows, missing cells, numeric flags and values per class of every column, in one pass.

    The flags ignore missing cells. Columns of tables without rows have ``n_rows`` 0. Patterns are tried only
    on values whose plain look does not say it all.
    """
    value, look, own = F.col("value"), F.col("_look"), F.col("_class")
    filled, integer, number = value.isNotNull(), look == "integer", look.isin("integer", "float")

    def all_filled(plain: Column, test: Column) -> Column:
        return F.every(F.when(filled, F.when(look.isNotNull(), plain).otherwise(test)))

    seen = cells.withColumn("_look", plain_look(value)).withColumn(
        "_class", F.when(filled, F.coalesce(look, value_class(value))))
    per_column = seen.groupBy(*COLUMN).agg(
        F.count("*").alias("n_rows"),
        F.count("value").alias("n_values"),
        all_filled(integer, as_long(value).isNotNull()).alias("all_long"),
        all_filled(integer & ~value.startswith("-"), is_uint64(value)).alias("all_uint64"),
        all_filled(number, as_double(value).isNotNull()).alias("all_double"),
        *[F.count_if(own == name).alias(f"n_{name}") for name in CLASSES],
    )
    return (
        columns_meta.join(per_column, COLUMN, "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        .withColumn("n_values", F.coalesce("n_values", F.lit(0)))
    )


def vote() -> Column:
    """The class that wins among all values of a column (``column_stats``).

    A class with 70 % of the values wins, where blank means other; a mix of numbers and
    blanks is float; anything else is other. Equal counts cannot reach 70 %, so ties do
    not matter.
    """
    out = F.when((F.col("n_string") == 0) & (F.col("n_other") == 0), "float").otherwise("other")
    for name in CLASSES:
        wins = F.col(f"n_{name}") * 100 >= F.col("n_values") * VOTE_SHARE
        out = F.when(wins, "other" if name == "null" else name).otherwise(out)
    return out


def column_types(cells: DataFrame, columns_meta: DataFrame,
                 stats: DataFrame | None = None) -> DataFrame:
    """``data_type`` of every column with its row and value counts, from one scan of the cells.

    Whole numbers without gaps are integer, other numbers float, text without gaps string;
    text with gaps goes by the vote of all its values. A column of a typed source
    (``source_type`` integer or float) skips the text rules. Columns without values are float,
    without rows string.
    """
    stats = column_stats(cells, columns_meta) if stats is None else stats
    no_gap = F.col("n_values") == F.col("n_rows")
    source = F.col("source_type")
    data_type = (
        F.when(source == "float", "float")
        .when(source == "integer", F.when(no_gap, "integer").otherwise("float"))
        .when(F.col("n_rows") == 0, "string")
        .when(F.col("n_values") == 0, "float")
        .when(no_gap & (F.col("all_long") | F.col("all_uint64")), "integer")
        .when(F.col("all_double"), "float")
        .when(no_gap, "string")
        .otherwise(vote())
    )
    return stats.select(
        *COLUMN, "col_name", "n_rows", "n_values", data_type.alias("data_type"),
        "all_long", "all_uint64", "all_double")


def nonempty_columns(stats: DataFrame) -> DataFrame:
    """Columns with at least one value."""
    return stats.filter(F.col("n_values") > 0)
