"""Typed tables as cells: Parquet files and lakes stored by this package."""

import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.functions.frames import join_small
from tablekin.functions.values import null_if_missing
from tablekin.schema import COLUMN, COLUMNS_META_SCHEMA

# listings and schemas asked for at once; both come from the file system, not from the data
READERS = 16
# row numbers of one file
FILE_BITS = 40


def _source_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "integer"
    return "float" if isinstance(data_type, T.FractionalType) else "text"


def _as_text(name: str, data_type: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(data_type, T.StringType):
        return null_if_missing(column)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    if isinstance(data_type, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")


def plain_path(uri: str) -> str:
    """A file's address with its signs decoded and one slash after the scheme."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", unquote(uri))


def readable_path(uri: str) -> str:
    """The address as a reader takes it: decoded, with the signs of patterns escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def _plain_path(uri: Column) -> Column:
    decoded = F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))
    return F.regexp_replace(decoded, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def _listed(spark: SparkSession, item: tuple[str, str]) -> tuple[str, list[str], T.StructType]:
    name, path = item
    frame = spark.read.parquet(path)
    files = sorted(frame.inputFiles())
    if not files:
        raise ValueError(f"table {name} has no files in {path}")
    return name, files, frame.schema


def read_parquet_lake(spark: SparkSession, tables: dict[str, str],
                      side: str) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``columns_meta`` of Parquet tables, given as name to path.

    Spark lists the files of each table, and rows find their table by the file they stand in.
    Tables with equal schema are read in one scan, so the plan grows with the number of
    schemas and not of tables. A row's id is made of the number of its file in the table
    and its place there, so it is the same in every run. A table without files is an error.
    """
    with ThreadPoolExecutor(READERS) as pool:
        listed = list(pool.map(lambda item: _listed(spark, item), tables.items()))
    groups: dict[str, list[tuple[str, list[str]]]] = defaultdict(list)
    schemas: dict[str, T.StructType] = {}
    for name, files, schema in listed:
        schemas[schema.json()] = schema
        groups[schema.json()].append((name, files))
    cells, meta_rows = [], []
    for key, members in groups.items():
        schema = schemas[key]
        owners = [(plain_path(file), name, number) for name, files in members
                  for number, file in enumerate(files)]
        files = sorted({file for _, own in members for file in own})
        # values first: a column of the tables may have the name of a helper column
        values = [F.struct(F.lit(pos).alias("col_pos"), F.lit(field.name).alias("col_name"),
                           _as_text(field.name, field.dataType).alias("value"))
                  for pos, field in enumerate(schema.fields)]
        found = _files(spark, schema, files, members, tables)
        rows = found.select(F.col("_metadata.file_path").alias("file"),
                            F.col("_metadata.row_index").alias("row_index"), F.array(*values).alias("values"))
        # addresses are made plain once for each file, not for each row
        owner = found.select(F.col("_metadata.file_path").alias("file")).distinct().withColumn("plain", _plain_path(F.col("file"))).join(
            spark.createDataFrame(owners, "plain string, table_name string, number long"), "plain").drop("plain")
        named = join_small(rows, owner, ["file"], len(owners), spread=["row_index"])
        cells.append(named.select(
            F.lit(side).alias("side"), "table_name",
            (F.shiftleft("number", FILE_BITS) + F.col("row_index")).alias("row_id"), F.inline("values"),
        ).select(*COLUMN, "col_name", "row_id", "value"))
        meta_rows += [(side, name, pos, f.name, _source_type(f.dataType))
                      for name, _ in members for pos, f in enumerate(schema.fields)]
    return reduce(DataFrame.unionByName, cells), spark.createDataFrame(meta_rows, COLUMNS_META_SCHEMA)


def _files(spark: SparkSession, schema: T.StructType, files: list[str], members: list,
           tables: dict[str, str]) -> DataFrame:
    """The rows of all files; folders that hold columns in their names are read table by table."""
    if any(re.search(r"/[^/=]+=[^/]*/[^/]*$", plain_path(file)) for file in files):
        paths = sorted({tables[name] for name, _ in members})
        return reduce(DataFrame.union, [spark.read.schema(schema).parquet(path).select(
            "*", "_metadata") for path in paths])
    return spark.read.schema(schema).parquet(*[readable_path(file) for file in files])


def store_lake(cells: DataFrame, columns_meta: DataFrame, folder: str) -> None:
    """Writes a lake once as Parquet, cells by side, so that every later scan is columnar."""
    cells.write.mode("overwrite").partitionBy("side").parquet(f"{folder}/cells")
    columns_meta.write.mode("overwrite").parquet(f"{folder}/columns_meta")


def load_lake(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cells = spark.read.parquet(f"{folder}/cells")
    return cells.select(*COLUMN, "col_name", "row_id", "value"), spark.read.parquet(
        f"{folder}/columns_meta")
