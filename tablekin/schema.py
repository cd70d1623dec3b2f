"""The frames every operator works on.

A lake has no common schema, so its tables are held as one long frame of cells:

``cells``         side, table_name, col_pos, col_name, row_id, value
``columns_meta``  side, table_name, col_pos, col_name, source_type
``gt``            query_table, cand_table

Missing cells are rows with a null value, so each row of a table has one cell per column.
``columns_meta`` also lists the columns of tables without rows.
"""

from pyspark.sql import types as T

LAKE = "lake"
QUERY = "query"

TABLE = ["side", "table_name"]
COLUMN = ["side", "table_name", "col_pos"]

CELLS_SCHEMA = T.StructType(
    [
        T.StructField("side", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("col_pos", T.IntegerType()),
        T.StructField("col_name", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)

COLUMNS_META_SCHEMA = T.StructType(
    [
        T.StructField("side", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("col_pos", T.IntegerType()),
        T.StructField("col_name", T.StringType()),
        T.StructField("source_type", T.StringType()),
    ]
)

GT_SCHEMA = T.StructType(
    [
        T.StructField("query_table", T.StringType()),
        T.StructField("cand_table", T.StringType()),
    ]
)

DATA_TYPES = ["integer", "float", "string", "other"]

# dimension of the entry of weight 0 that every vectorised column and table has; it keeps
# vectors without any other entry in the frame, and counts the columns of a table
MARK = -1
