"""Column vectors pooled to one vector per table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekin.schema import MARK, TABLE


def table_vectors(vectors: DataFrame, agg: str) -> DataFrame:
    """max, sum or mean over the columns of a table: ``side, table_name, dim, weight``.

    Absent entries are 0. So max needs weights >= 0, which all sparse features have, and
    mean divides by the number of columns with a vector, not by that of the entries present.
    """
    by_dim = vectors.groupBy(*TABLE, "dim")
    if agg == "max":
        return by_dim.agg(F.max("weight").alias("weight"))
    if agg == "sum":
        return by_dim.agg(F.sum("weight").alias("weight"))
    if agg == "mean":
        n_units = F.max(F.when(F.col("dim") == MARK, F.col("_n"))).over(
            Window.partitionBy(*TABLE))
        return by_dim.agg(F.sum("weight").alias("weight"), F.count("*").alias("_n")).withColumn(
            "weight", F.col("weight") / n_units).drop("_n")
    raise ValueError(f"no such pooling: {agg}")


def dense_table_vectors(vectors: DataFrame, agg: str, keys: list[str] = TABLE,
                        vec: str = "vec") -> DataFrame:
    """The same for dense vectors, held as one array per column."""
    pick: dict[str, Column] = {
        "max": F.max("x"), "sum": F.sum("x"), "mean": F.avg("x")}
    if agg not in pick:
        raise ValueError(f"no such pooling: {agg}")
    entries = vectors.select(*keys, F.posexplode(vec).alias("pos", "x")).withColumn(
        "x", F.col("x").cast("double"))
    pooled = entries.groupBy(*keys, "pos").agg(pick[agg].alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return pooled.groupBy(*keys).agg(
        F.transform(ordered, lambda entry: entry["x"]).alias("vec"))
