"""Column names of a table made unique, as a CSV reader does it."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.schema import TABLE


def unique_names(names: list[str]) -> list[str]:
    """Blank names become ``Unnamed: position``; repeats get .1, .2, skipping taken ones."""
    named = [name if name else f"Unnamed: {pos}" for pos, name in enumerate(names)]
    taken, seen, result = set(named), {}, []
    for name in named:
        if name not in seen:
            seen[name] = 0
            result.append(name)
            continue
        while True:
            seen[name] += 1
            candidate = f"{name}.{seen[name]}"
            if candidate not in taken:
                break
        taken.add(candidate)
        seen.setdefault(candidate, 0)
        result.append(candidate)
    return result


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unique_names(headers: pd.Series) -> pd.Series:
    return headers.map(lambda names: unique_names([name or "" for name in names]))


def disambiguate_headers(columns_meta: DataFrame) -> DataFrame:
    """``columns_meta`` with unique column names in every table."""
    ordered = F.array_sort(F.collect_list(F.struct("col_pos", "col_name", "source_type")))
    headers = columns_meta.groupBy(*TABLE).agg(ordered.alias("columns"))
    named = headers.withColumn("names", _unique_names(
        F.transform("columns", lambda c: F.coalesce(c["col_name"], F.lit("")))))
    return named.select(*TABLE, F.explode(F.arrays_zip("columns", "names")).alias("c")).select(
        *TABLE, F.col("c.columns.col_pos").alias("col_pos"), F.col("c.names").alias("col_name"),
        F.col("c.columns.source_type").alias("source_type"))
