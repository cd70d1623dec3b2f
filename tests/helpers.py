"""Small lakes written as dicts of columns."""

from pyspark.sql import DataFrame, SparkSession

from tablekin.functions.values import null_if_missing
from tablekin.schema import CELLS_SCHEMA, COLUMNS_META_SCHEMA, GT_SCHEMA


def lake_of(spark: SparkSession, tables: dict[tuple[str, str], dict[str, list]]
            ) -> tuple[DataFrame, DataFrame]:
    """``{(side, table): {column: values}}`` as cells and columns_meta."""
    cells, meta = [], []
    for (side, table), columns in tables.items():
        for pos, (name, values) in enumerate(columns.items()):
            meta.append((side, table, pos, name, "text"))
            cells += [(side, table, pos, name, row, None if v is None else str(v))
                      for row, v in enumerate(values)]
    frame = spark.createDataFrame(cells, CELLS_SCHEMA)
    return (frame.withColumn("value", null_if_missing(frame["value"])),
            spark.createDataFrame(meta, COLUMNS_META_SCHEMA))


def gt_of(spark: SparkSession, edges: dict[str, list]) -> DataFrame:
    return spark.createDataFrame(
        [(q, c) for q, cands in edges.items() for c in cands], GT_SCHEMA)


def rows(df: DataFrame, *names: str) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*names).collect())
