"""Records of experiment runs: status, times, metrics and per-query rankings."""

from hashlib import md5
from threading import Lock
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = """
    run string, benchmark string, method string, k int, exclude_self boolean,
    embedding_params map<string,string>, eval_params map<string,string>,
    status string, error string, traceback string, offline double, online double,
    vector_path string
"""
METRICS = "array<struct<cutoff: int, p: double, r: double, f1: double, map: double>>"
JSON_SCHEMA = f"{RUN_SCHEMA.rstrip()}, run_id string, finished string, metrics {METRICS}, run_key string"


class ResultStore:
    """``runs`` has one record per combination, ``details`` one per run and query.

    Details are written first, so a record that is there has all of them. ``run`` tells
    repeated runs apart and is part of ``run_id``, as are k and ``exclude_self``. What is written again
    under one ``run_id`` takes the place of what an interrupted attempt left. Threads may share a store.
    """

    def __init__(self, root: str, fmt: str = "json"):
        self.root = root.rstrip("/")
        self.fmt = fmt
        self._lock = Lock()

    def append(self, spark: SparkSession, record: dict[str, Any],
               metrics: DataFrame | None = None, detail: DataFrame | None = None) -> None:
        row = spark.createDataFrame([record], RUN_SCHEMA).withColumn(
            "run_id", F.lit(self.run_id(record))).withColumn("finished", F.current_timestamp())
        if metrics is None:
            row = row.withColumn("metrics", F.lit(None).cast(METRICS))
        else:
            # k rows
            listed = metrics.agg(F.array_sort(F.collect_list(F.struct(
                "cutoff", "p", "r", "f1", "map"))).alias("metrics"))
            row = row.crossJoin(listed)
        with self._lock:
            if detail is not None:
                self._write(detail.withColumn("run_id", F.lit(self.run_id(record))).withColumn(
                    "benchmark", F.lit(record["benchmark"])), record, "details")
            self._write(row, record, "runs")

    def _write(self, frame: DataFrame, record: dict[str, Any], name: str) -> None:
        """One folder per run_id, written over if it is there."""
        key = "r" + md5(self.run_id(record).encode()).hexdigest()
        frame.withColumn("run_key", F.lit(key)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("benchmark", "run_key").format(self.fmt).save(
            f"{self.root}/{name}")

    @staticmethod
    def run_id(record: dict[str, Any]) -> str:
        parts = [f"{k}={v}" for name in ("embedding_params", "eval_params")
                 for k, v in sorted(record[name].items())]
        return "_".join([record["method"], *parts, f"k={record['k']}",
                         f"exclude_self={record['exclude_self']}", record["run"]])

    def runs(self, spark: SparkSession) -> DataFrame:
        """All records; the columns do not depend on which of them have errors or which parameters."""
        reader = spark.read.format(self.fmt)
        if self.fmt == "json":  # null fields are not written, and maps would be read as structs
            reader = reader.schema(JSON_SCHEMA)
        return reader.load(f"{self.root}/runs").drop("run_key")

    def details(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.fmt).load(f"{self.root}/details").drop("run_key")

    def finished(self, spark: SparkSession, run: str) -> set[str]:
        """The ``run_id`` of all records of a run but failed ones; one for each combination of its grid."""
        try:
            found = self.runs(spark).filter((F.col("run") == run) & (F.col("status") != "failed"))
            return {row["run_id"] for row in found.select("run_id").collect()}
        except AnalysisException:  # nothing is stored yet
            return set()
