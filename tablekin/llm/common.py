"""What the operators share: row keys, stages in the shared folder, stable text samples."""

import ctypes
import gc
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, ROW = "_key", "_row"
BATCH_BYTES = 1 << 20  # of whole texts that Python gets at once, where a stage asks for small batches
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BROADCAST_KEYS = 500_000  # keys of rows to be left out that are broadcast; more are found by a join
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shipped(module: str) -> None:
    """Sends a module's functions to executors by value, so they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def by_value(spark: SparkSession, thing: Any) -> Broadcast:
    """A small object broadcast with its class, for executors without this package; ``opened`` gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def opened(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its memory back to the system at the end of a partition.

    Workers live on from stage to stage, and what one of them keeps for later is missing elsewhere.
    """

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tablekin-")
        context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet to the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Frames that run meanwhile pass rows to Python by ``BATCH_BYTES`` at most; only memory depends on it.

    Executors and workers each hold two batches, in buffers that grow by doubling: by Spark's own bound some
    200 MB a core. An executor keeps part of what large buffers took for as long as it lives, so all stages of a
    pipeline ask for small ones.
    """
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, the named columns and ``_key``, a long that no two rows share.

    The key is doc_id where all are present and different. Otherwise rows are numbered in order
    of doc_id (nulls first) and the first column; equal rows get neighbouring numbers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    ids = docs.groupBy("doc_id").count().agg(
        F.max("count").alias("most"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    if (ids["most"] or 1) == 1 and ids["nulls"] == 0:
        return docs.withColumn(KEY, F.col("doc_id"))
    numbered = docs.orderBy(*[F.col(c).asc_nulls_first() for c in ["doc_id", *columns[:1]]])
    return stage(numbered.withColumn(KEY, F.monotonically_increasing_id()))


def keyed_whole(docs: DataFrame) -> DataFrame:
    """doc_id, text, ``_key`` and ``_row``, the whole row; other columns may have any name."""
    return keyed(docs.select("doc_id", "text", F.struct("*").alias(ROW)), "text", ROW)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The whole rows whose ``_key`` is not in ``gone``, with the columns they had.

    Keys are counted; up to a bound they are broadcast, so that whole rows are not shuffled.
    """
    gone = stage(gone.select(KEY))
    few = gone.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(gone) if few else gone, KEY, "left_anti").select(f"{ROW}.*")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def labelled_sample(labels: DataFrame, column: str, bound: int, rows: Column | None = None) -> DataFrame:
    """(doc_id, label) of about ``bound`` labelled documents at most, chosen by a hash of the id.

    Null ids and labels are left out; of several labels of a document the lowest counts. The share
    that is taken leaves some room, so that the sample stays under the bound.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.dropna() if rows is None else known.dropna().filter(rows)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    n = known.count()
    if n <= bound:
        return known
    share = 0.97 * bound / n
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
