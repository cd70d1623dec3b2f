"""Vectors kept as Parquet by lake, method and parameters, and used again for the same ones.

A lake goes by its name alone (``get_or_build``) or also by what its tables hold (``refresh``).
"""

import uuid
from collections import defaultdict
from collections.abc import Callable
from hashlib import md5
from threading import Lock
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablekin.functions.frames import cut, join_small
from tablekin.schema import TABLE

MANIFEST = "lake string, state string, params map<string,string>, version string, shared string, whole boolean"
MAX_VERSIONS = 16


def table_prints(cells: DataFrame, columns_meta: DataFrame) -> DataFrame:
    """``side, table_name, print``: a fingerprint of every table's columns and cells.

    It does not depend on the order of rows in the frames. Two 64-bit hashes of every cell are combined by
    exclusive or, so tasks send on one row per table; a cell stands in a frame once.
    """
    def hashed(*parts):
        return (F.xxhash64(*parts).alias("one"), F.xxhash64(F.lit("again"), *parts).alias("two"))

    # hashes pass over nulls, so a null says that it is one
    cell = hashed(F.lit("cell"), "col_pos", "col_name", "row_id", F.col("value").isNull(), "value")
    column = hashed(F.lit("column"), "col_pos", "col_name")
    parts = cells.select(*TABLE, *cell).unionByName(columns_meta.select(*TABLE, *column))
    return parts.groupBy(*TABLE).agg(F.concat_ws(
        ":", F.count("*"), F.hex(F.bit_xor("one")), F.hex(F.bit_xor("two"))).alias("print"))


class VectorStore:
    """Folders ``lake=<l>/method=<m>/param_hash=<h>`` with ``vectors`` and a ``manifest``.

    One lake's vectors are never taken for another's. The manifest names all parameters; it
    says ``complete`` only after the vectors are written, and vectors without that are built
    again.

    ``refresh`` adds a folder of vectors for each version of the lake that changed some tables, and a list of
    all tables with the version their vectors lie in. Beyond ``max_versions`` folders in use, vectors are
    written together again. Folders that no list names any more stay for those who still read them.
    Threads of one driver may share a store; drivers may not refresh the same vectors at once.
    """

    def __init__(self, spark: SparkSession, root: str, max_versions: int = MAX_VERSIONS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.max_versions = max_versions
        self._locks: defaultdict[str, Lock] = defaultdict(Lock)

    def path(self, lake: str, method: str, params: dict[str, Any]) -> str:
        text = str(sorted((key, str(value)) for key, value in params.items()))
        return (f"{self.root}/lake={md5(lake.encode()).hexdigest()}/method={method}/"
                f"param_hash={md5(text.encode()).hexdigest()}")

    def _declare(self, path: str, lake: str, params: dict[str, Any], state: str, version: str | None = None,
                 shared: str | None = None, whole: bool = True) -> None:
        row = [(lake, state, {key: str(value) for key, value in params.items()}, version, shared, whole)]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")

    def load(self, lake: str, method: str, params: dict[str, Any]) -> DataFrame | None:
        path = self.path(lake, method, params)
        try:
            declared = self.spark.read.schema("state string").json(f"{path}/manifest").first()
            if declared is None or declared["state"] != "complete":
                return None
            return self.spark.read.parquet(f"{path}/vectors")
        except AnalysisException:
            return None

    def save(self, vectors: DataFrame, lake: str, method: str, params: dict[str, Any]) -> None:
        path = self.path(lake, method, params)
        self._declare(path, lake, params, "started")
        vectors.write.mode("overwrite").partitionBy("side").parquet(f"{path}/vectors")
        self._declare(path, lake, params, "complete")

    def get_or_build(self, lake: str, method: str, params: dict[str, Any],
                     build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The stored vectors and whether they were there before."""
        stored = self.load(lake, method, params)
        if stored is not None:
            return stored, True
        self.save(build(), lake, method, params)
        built = self.load(lake, method, params)
        if built is None:
            raise RuntimeError(f"vectors were not stored: {self.path(lake, method, params)}")
        return built, False

    def _declared(self, path: str) -> Row | None:
        try:
            found = self.spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
        except AnalysisException:
            return None
        return found if found is not None and found["state"] == "complete" and found["version"] else None

    def table_versions(self, lake: str, method: str, params: dict[str, Any]) -> DataFrame | None:
        """``side, table_name, print, version`` of the refreshed vectors in force."""
        path = self.path(lake, method, params)
        declared = self._declared(path)
        return None if declared is None else self._tables(path, declared["version"])

    def _tables(self, path: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{path}/tables/{version}")

    def _vectors(self, path: str, tables: DataFrame, whole: str | None) -> DataFrame:
        """Vectors of the listed tables, each from its version; ``whole``: the version that holds just these."""
        versions = [whole] if whole else [row["version"] for row in tables.select("version").distinct().collect()]
        stored = self.spark.read.option("basePath", f"{path}/vectors").parquet(
            *[f"{path}/vectors/version={version}" for version in versions])
        if not whole:
            spread = [name for name in stored.columns if name not in (*TABLE, "version")]
            stored = join_small(stored, tables.select(*TABLE, "version"), [*TABLE, "version"], tables.count(), spread)
        return stored.drop("version")

    def refresh(self, lake: str, method: str, params: dict[str, Any], prints: DataFrame,
                build: Callable[[DataFrame | None, int], DataFrame], shared: str = "") -> tuple[DataFrame, int]:
        """Vectors of the tables as they are now, and how many tables were built for that.

        ``prints`` are those of ``table_prints``. ``build(tables, n)`` gives the vectors of the n tables named
        in a frame, of all where that is None. ``shared`` stands for what the vectors of all tables depend
        on: if it changed, all are built. Tables that are gone have no vectors any more. A refresh that
        stops half-way leaves the last one in force, or none.
        """
        path = self.path(lake, method, params)
        with self._locks[path]:
            declared = self._declared(path)
            old = None if declared is None or declared["shared"] != shared else self._tables(path, declared["version"])
            if old is None:
                state = cut(prints.withColumn("version", F.lit(None).cast("string")))
            else:
                before = old.select(*TABLE, F.col("print").alias("was"), "version")
                state = cut(prints.join(before, TABLE, "left").select(
                    *TABLE, "print", F.when(F.col("print") == F.col("was"), F.col("version")).alias("version")))
            n_all, n_changed = state.agg(F.count("*"), F.count_if(F.col("version").isNull())).first()
            if old is not None and n_changed == 0 and old.count() == n_all:
                return self._vectors(path, old, declared["version"] if declared["whole"] else None), 0
            kept = state.filter(F.col("version").isNotNull())
            changed = state.filter(F.col("version").isNull())
            n_versions = kept.select("version").distinct().count()
            whole = n_changed == n_all or n_versions >= self.max_versions
            version = f"v{uuid.uuid4().hex}"
            if n_changed or whole:
                new = build(None if n_changed == n_all else changed.select(*TABLE), n_changed)
                if whole and n_versions:
                    new = new.unionByName(self._vectors(path, kept, None))
                new.write.parquet(f"{path}/vectors/version={version}")
            tables = state.withColumn("version", F.lit(version) if whole else F.coalesce("version", F.lit(version)))
            tables.write.parquet(f"{path}/tables/{version}")
            self._declare(path, lake, params, "complete", version, shared, whole)
            return self._vectors(path, self._tables(path, version), version if whole else None), n_changed
