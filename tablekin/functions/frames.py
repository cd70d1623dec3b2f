"""Joins and per-group selections that do not depend on how rows spread over keys."""

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 16
BROADCAST_ROWS = 500_000


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    spread: list[str], rank: str = "rn", salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 in ``rank``.

    Every group is first cut into ``salts`` parts by the ``spread`` columns, and only the first
    ``n`` rows of each part meet. So a group that holds most rows is ranked by many tasks, with
    any session settings; where Spark also limits window groups in map tasks, less still is
    shuffled. ``salts=1`` is for groups known to be small.
    """
    by_group = Window.partitionBy(*keys).orderBy(*order)
    if salts > 1:
        by_part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(salts)))
            .withColumn(rank, F.row_number().over(by_part))
            .filter(F.col(rank) <= n)
            .drop("_part", rank)
        )
    return df.withColumn(rank, F.row_number().over(by_group)).filter(F.col(rank) <= n)


def join_small(big: DataFrame, small: DataFrame, on: list[str], small_rows: int,
               spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join with a frame of at most ``small_rows`` rows, safe when one key holds most rows.

    Below ``BROADCAST_ROWS`` the small side is broadcast. Above it both sides are shuffled
    with a salt: rows of ``big`` take one by their ``spread`` columns, those of ``small``
    are repeated for each, so the rows of one key are shared by ``salts`` tasks.
    """
    if small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that ``spark.checkpoint.dir`` names; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    folder = folder or tempfile.mkdtemp(prefix="tablekin-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder, for plans that use it several times.

    Lost executors do not lose the data.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
