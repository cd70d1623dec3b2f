"""Whitening of embeddings along their leading principal components.

Entries become whole numbers, floor(256 * c). The covariance is that of the distinct vectors, so that copies
do not bend it: sums per dimension are exact, every vector is centred before it is multiplied, and tasks
send one matrix each, whose entries Spark adds up. Eigenpairs are worked out from that one matrix (see
``eigen``), which grows with the dimension alone; the projection is broadcast and meets all rows in place.

Rows whose vector is null, or has a null entry, one that is not finite or one too large for a long, are left out. So are
empty vectors and those of another length than most vectors have (of lengths equally frequent, the
longest counts). Repeated rows, and rows without vec_id, are rows like others. Components whose eigenvalue is at most
1e-12 of the trace have no direction of their own and are not made: vectors that are all
equal, and empty tables, give no rows. Other columns pass through ``whiten``; the report ignores them.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekin.llm.common import ROW, shipped, stage
from tablekin.llm.eigen import leading_pairs
from tablekin.llm.vectors import finite, largest, matrix, whole

shipped(__name__)

FLAT = 1e-12
LONG = 2**63


@dataclass(frozen=True)
class Whitening:
    """What was learnt: counts and sums of the distinct vectors, the components kept, how well they fit."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(total, self.n)) for total in self.sums])

    @property
    def projection(self) -> np.ndarray:
        """One column per component: what centred vectors are multiplied with."""
        return (self.components / np.sqrt(self.values)[:, None]).T


def taken(vectors: DataFrame) -> DataFrame:
    """``x`` and ``_row``, the whole row, of all rows that are not left out."""
    rows = vectors.select(F.struct("*").alias(ROW), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter(finite(F.col("e"))).filter((F.size("e") > 0) & (largest(F.col("e")) < float(LONG)))
    lengths = rows.groupBy(F.size("e").alias("length")).count()
    most = lengths.orderBy(F.col("count").desc(), F.col("length").desc()).first()
    return rows.filter(F.size("e") == (most["length"] if most else -1)).select(whole(F.col("e")).alias("x"), ROW)


def _long_sums(x: np.ndarray) -> list[int]:
    if not len(x):
        return [0] * x.shape[1]
    if max(abs(int(x.max())), abs(int(x.min()))) < LONG // len(x):
        return [int(total) for total in x.sum(axis=0)]
    return list(x.astype(object).sum(axis=0))


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    totals = [0] * width
    for batch in batches:
        totals = [a + b for a, b in zip(totals, _long_sums(matrix(batch.column("x"), width)), strict=True)]
    yield pa.RecordBatch.from_pydict({"at": list(range(width)), "total": [str(total) for total in totals]})


def _products(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Products of centred and projected vectors, summed: the upper triangle."""
    mean, projection = shared.value
    total = None
    for batch in batches:
        y = matrix(batch.column("x"), len(mean)) - mean
        y = y if projection is None else y @ projection
        total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        row, col = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(total[row, col])], ["i", "j", "total"])


def covariance(fit_list: DataFrame, n: int, mean: np.ndarray, projection: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor ``n``) of ``x``, or of its projections; tasks send one triangle each."""
    shared = fit_list.sparkSession.sparkContext.broadcast((mean, projection))
    parts = fit_list.mapInArrow(partial(_products, shared=shared), "i long, j long, total double")
    summed = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    row, col, total = (summed.column(name).to_numpy() for name in ("i", "j", "total"))
    width = len(mean) if projection is None else projection.shape[1]
    out = np.zeros((width, width))
    out[row, col] = out[col, row] = total / n
    return out


def fit(rows: DataFrame, k: int) -> Whitening | None:
    """Learns ``k`` components at most from the distinct ``x`` of the rows; None if there are no rows."""
    fit_list = stage(rows.select("x").distinct())
    n = fit_list.count()
    if not n:
        return None
    width = fit_list.select(F.size("x").alias("width")).first()["width"]
    sums = fit_list.mapInArrow(partial(_sums, width=width), "at long, total string").groupBy("at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    learnt = Whitening(n, [int(row["total"]) for row in sorted(sums, key=lambda row: row["at"])],
                       np.zeros(0), np.zeros((0, width)), 0.0, 0.0)
    spread = covariance(fit_list, n, learnt.mean)
    trace = float(np.trace(spread))
    values, components = leading_pairs(spread, k)
    kept = values > FLAT * trace
    learnt = Whitening(n, learnt.sums, values[kept], components[kept], trace, 0.0)
    if not kept.any():
        return learnt
    white = covariance(fit_list, n, learnt.mean, learnt.projection)
    error = float(np.abs(white - np.eye(len(white))).max())
    return Whitening(n, learnt.sums, learnt.values, learnt.components, trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums of (n * x - S)^2, exact; null where a long cannot hold one."""
    reach = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if x.size else 0
    if reach * reach * len(sums) < LONG:
        centred = n * x - np.array(sums, np.int64)
        return pa.array((centred * centred).sum(axis=1))
    centred = x.astype(object) * n - np.array(sums, object)
    return pa.array([value if value < LONG else None for value in (centred * centred).sum(axis=1)], pa.int64())


def _projected(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    n, sums, mean, projection = shared.value
    for batch in batches:
        x = matrix(batch.column("x"), len(mean))
        made = (x - mean) @ projection
        white = pa.ListArray.from_arrays(
            pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(ROW), _deviations(x, n, sums), white], [ROW, "deviation", "whitened"])


def whiten(rows: DataFrame, learnt: Whitening) -> DataFrame:
    """``_row``, ``deviation`` and ``whitened``, one entry per component, of ``taken`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast((learnt.n, learnt.sums, learnt.mean, learnt.projection))
    schema = T.StructType([rows.schema[ROW], T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(partial(_projected, shared=shared), schema)


def report(vectors: DataFrame, k: int = 4) -> DataFrame:
    """One row for every row taken and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = taken(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    learnt = fit(rows, k)
    if learnt is None or not len(learnt.values):
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*[F.lit(float(value / learnt.trace)) for value in learnt.values])
    narrow = rows.select("x", F.struct(F.col(f"{ROW}.vec_id").alias("vec_id")).alias(ROW))
    return whiten(narrow, learnt).select(
        f"{ROW}.vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(learnt.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, "place").alias("explained"),
        F.lit(learnt.identity_error).alias("identity_error"))
