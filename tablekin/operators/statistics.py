"""Exact statistics of values between 0 and 1, with quantiles that need no global sort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1000
QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p10": 0.1, "p90": 0.9}


def unit_interval_stats(values: DataFrame, value: str, keys: list[str],
                        sets: list[list[str]] | None = None) -> DataFrame:
    """count, mean, median, std, min, max, q1, q3, iqr, p10 and p90 per group.

    Groups are those of all ``keys``, or with ``sets`` those of several choices of them in one
    pass; keys that a choice leaves out are null then, and ``grouping_id`` tells choices apart
    (a bit for each key left out, that of the last key is 1).

    Equal values are counted first, so a value that fills a third of the rows is one row.
    The positions of the others come from counts per thousandth of [0, 1]: one window runs
    over the bucket counts of a group, another inside each bucket. Quantiles are linear
    interpolations, the deviation is that of the population.
    """
    several = [keys] if sets is None else sets
    counted = values.select(*keys, F.col(value).alias("v")).groupingSets(
        [[*chosen, "v"] for chosen in several], *keys, "v").agg(
        F.count("*").alias("n"), F.shiftright(F.grouping_id(), 1).alias("grouping_id"))
    counted = counted.withColumn("_bucket", F.floor(F.col("v") * BUCKETS))
    wanted, keys = keys, [*keys, "grouping_id"]
    group = [F.col(key) for key in keys]
    buckets = counted.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_in_bucket"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*group)
    # at most BUCKETS + 1 rows per group
    offsets = buckets.select(
        *[F.col(key).alias(f"_of_{key}") for key in [*keys, "_bucket"]],
        (F.sum("_in_bucket").over(earlier) - F.col("_in_bucket")).alias("_before"),
        F.sum("_in_bucket").over(everything).alias("_total"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # keys of a larger group are null
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in [*keys, "_bucket"]]
    placed = counted.join(offsets, same).withColumn(
        "_end", F.col("_before") + F.sum("n").over(inside))
    last = F.col("_total") - 1

    def value_at(position):
        here = (position >= F.col("_end") - F.col("n")) & (position < F.col("_end"))
        return F.max(F.when(here, F.col("v")))

    picks = []
    for name, q in QUANTILES.items():
        picks += [value_at(F.floor(last * q)).alias(f"_{name}_low"),
                  value_at(F.ceil(last * q)).alias(f"_{name}_high")]
    total = F.sum("n")
    mean = F.sum(F.col("v") * F.col("n")) / total
    stats = placed.groupBy(*keys).agg(
        total.alias("count"), mean.alias("mean"),
        F.sum(F.col("v") * F.col("v") * F.col("n")).alias("_squares"),
        F.min("v").alias("min"), F.max("v").alias("max"), *picks)
    n = F.col("count")
    for name, q in QUANTILES.items():
        at = (n - 1) * q
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        stats = stats.withColumn(name, low + (high - low) * (at - F.floor(at)))
    variance = F.col("_squares") / n - F.col("mean") * F.col("mean")
    return stats.select(
        *(wanted if sets is None else keys), "count", "mean", "median",
        F.when(F.col("min") == F.col("max"), 0.0)
        .otherwise(F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        "min", "max", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "p10", "p90")
