"""Exact best-k search over unit vectors that multiplies only what can still matter.

Candidates are laid out once: each goes to the nearest of a few hundred pivots (candidates chosen by a hash),
and they are ranged by pivot and by their angle to it. Blocks of rows that follow each other then cover a narrow ring
around a pivot, and the angle between a query and the pivot bounds the cosine of all of them. For sparse vectors the
largest weight of each dimension in the block gives a second bound.

Queries are broadcast in blocks of counted size; candidates stay where they lie. The first round multiplies
each query with the rings of its nearest pivots only, which hold at least as many candidates as are asked for. The k-th best score found
is the threshold of the second round, in which a block is skipped for all queries whose bound lies below it; a task
raises the thresholds further as it goes. Both only leave out what cannot be among the best, so results are exact.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.functions.frames import cut

DIGITS = 6
# bounds are compared with room for rounding to DIGITS and for the error of angles
MARGIN = 4e-6
# queries broadcast at once, and the entries of their matrix
QUERY_BLOCK, QUERY_CELLS = 4_096, 8_000_000
# candidates whose bound is taken together, and the cells of a matrix made of sparse ones
RING, RING_CELLS = 512, 2_000_000
# pivots at most, candidates and queries for each at least: laying out costs a product with every pivot, so few queries
# get few pivots, and with fewer than these all products are made
PIVOTS, PER_PIVOT, PER_ASKED, FEWEST = 256, 500, 4, 8
PARTS_PER_CORE = 2
KEPT_ROWS = 200_000
NO_PIVOT = -1

FOUND = "query long, cand_table string, score double"


@dataclass(frozen=True)
class Layout:
    """Candidates as they lie: ``cand_table``, their vector, ``pivot`` and ``angle``."""

    rows: DataFrame
    values: list[str]
    pivots: dict  # of plain arrays
    sizes: dict[int, int]  # candidates by pivot


def vectors_of(batch, values: list[str], known: np.ndarray | None, low: int, high: int) -> np.ndarray:
    """Rows of a batch as a matrix: dense unit vectors, or sparse ones over the known dimensions."""
    part = [batch.column(name).slice(low, high - low) for name in values]
    lengths = part[0].value_lengths().to_numpy(zero_copy_only=False)
    if known is None:
        matrix = part[0].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(high - low, -1)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
    out = np.zeros((high - low, len(known)))
    dims = part[0].flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(high - low), lengths)
    at = np.minimum(np.searchsorted(known, dims), max(len(known) - 1, 0))
    here = known[at] == dims if len(known) else np.zeros(len(dims), bool)
    out[row[here], at[here]] = part[1].flatten().to_numpy(zero_copy_only=False)[here]
    return out


def _matrix(table, values: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
    """All vectors of a collected block, and the dimensions they use if they are sparse."""
    batch = table.combine_chunks()
    columns = {name: batch.column(name).combine_chunks() if batch.num_rows else pa.array([], batch.schema.field(name).type)
               for name in values}
    flat = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    known = None if len(values) == 1 else np.unique(columns[values[0]].flatten().to_numpy(zero_copy_only=False))
    return vectors_of(flat, values, known, 0, batch.num_rows), known


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _assigned(batches: Iterator[pa.RecordBatch], shared, values: list[str]) -> Iterator[pa.RecordBatch]:
    """Candidates with their nearest pivot and the angle to it; those of length 0 have none."""
    pivots, known = shared.value["matrix"], shared.value["known"]
    step = max(1, RING_CELLS // max(1, pivots.shape[1]))
    for batch in batches:
        nearest, angle = [np.zeros(0, np.int64)], [np.zeros(0)]
        for low in range(0, batch.num_rows, step):
            high = min(batch.num_rows, low + step)
            matrix = vectors_of(batch, values, known, low, high)
            cosines = matrix @ pivots.T
            best = cosines.argmax(axis=1)
            nearest.append(np.where(_has_length(batch, values, low, high), best, NO_PIVOT))
            angle.append(_angles(cosines[np.arange(high - low), best]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(nearest)), pa.array(np.concatenate(angle))],
                                         [*batch.schema.names, "pivot", "angle"])


def _has_length(batch, values: list[str], low: int, high: int) -> np.ndarray:
    part = batch.column(values[-1]).slice(low, high - low)
    row = np.repeat(np.arange(high - low), part.value_lengths().to_numpy(zero_copy_only=False))
    return np.bincount(row, np.abs(part.flatten().to_numpy(zero_copy_only=False).astype(float)), high - low) > 0


def laid_out(candidates: DataFrame, values: list[str], n: int, n_queries: int) -> Layout:
    """``n`` candidates ranged by pivot and angle and kept, which shuffles them once; few ones stay as they are."""
    rows = candidates.select("cand_table", *values)
    n_pivots = min(PIVOTS, n // PER_PIVOT, n_queries // PER_ASKED)
    if n_pivots < FEWEST:
        return Layout(rows.withColumns({"pivot": F.lit(NO_PIVOT).cast("long"), "angle": F.lit(0.0)}), values,
                      {"matrix": np.zeros((0, 0)), "known": None}, {})
    chosen = rows.orderBy(F.xxhash64("cand_table"), "cand_table").limit(n_pivots).toArrow()
    matrix, known = _matrix(chosen, values)
    pivots = {"matrix": matrix, "known": known}
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    # each block of queries runs a task a part, and each task tells the driver how it went: parts follow the cores, as rows stream
    parts = PARTS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    kept = cut(rows.mapInArrow(partial(_assigned, shared=shared, values=values), f"{fields}, pivot long, angle double")
               .repartitionByRange(parts, "pivot", "angle", F.xxhash64("cand_table"))
               .sortWithinPartitions("pivot", "angle"))
    sizes = {row["pivot"]: row["count"] for row in kept.groupBy("pivot").count().collect()}
    return Layout(kept, values, pivots, sizes)


class _Best:
    """The k best (score, name) of each query that a task has seen, with the score each has to reach."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.k, self.thresholds = k, thresholds.copy()
        self.top = np.full((len(thresholds), k), -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, asked: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the asked queries by the named candidates; -inf counts as no score."""
        keep = min(self.k, scores.shape[1])
        best = -np.partition(-scores, keep - 1, axis=1)[:, :keep]
        border = np.maximum(best.min(axis=1), self.thresholds[asked])
        row, col = np.nonzero((scores >= border[:, None]) & np.isfinite(scores))
        self.kept.append((asked[row], names[col], scores[row, col]))
        self.held += len(row)
        merged = -np.partition(-np.hstack([self.top[asked], best]), self.k - 1, axis=1)[:, :self.k]
        self.top[asked] = merged
        self.thresholds[asked] = np.maximum(self.thresholds[asked], merged.min(axis=1))
        if self.held > KEPT_ROWS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, name, score = (np.concatenate([part[i] for part in self.kept]) for i in range(3))
        order = np.lexsort((name, -score, query))
        query, name, score = query[order], name[order], score[order]
        first = np.arange(len(query)) - np.searchsorted(query, query, side="left") < self.k
        self.kept = [(query[first], name[first], score[first])]
        self.held = int(first.sum())
        return self.kept[0]


def _rings(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int]]:
    """Runs of at most ``size`` rows of one pivot."""
    pivots = batch.column("pivot").to_numpy()
    borders = [0, *(np.flatnonzero(np.diff(pivots)) + 1), batch.num_rows]
    for low, high in zip(borders, borders[1:], strict=False):
        for start in range(int(low), int(high), size):
            yield start, min(int(high), start + size)


def _search(batches: Iterator[pa.RecordBatch], shared, values: list[str], k: int, exclude_self: bool, first: bool | None,
            counts: Accumulator | None, all_counts: Accumulator | None) -> Iterator[pa.RecordBatch]:
    """The best of a task's candidates. ``first``: only the pairs of query and pivot of that round, or all others."""
    asked = shared.value
    matrix, known, angles = asked["matrix"], asked["known"], asked["angles"]
    size = RING if angles.shape[1] else 8 * RING
    if known is not None:
        size = max(1, min(size, RING_CELLS // max(1, len(known))))
    best, place = _Best(asked["thresholds"], k), {name: at for at, name in enumerate(asked["names"])}
    everyone, weights = np.arange(len(matrix)), np.abs(matrix)
    for batch in batches:
        names, pivots, own = batch.column("cand_table"), batch.column("pivot").to_numpy(), batch.column("angle").to_numpy()
        for low, high in _rings(batch, size):
            pivot = int(pivots[low])
            who, limit = everyone, np.full(len(matrix), np.inf)
            if pivot != NO_PIVOT:
                apart = np.maximum(angles[:, pivot] - own[low:high].max(), own[low:high].min() - angles[:, pivot])
                limit = np.cos(np.clip(apart, 0.0, np.pi))
            elif angles.shape[1]:
                limit = np.zeros(len(matrix))  # candidates of length 0
            wanted = limit >= best.thresholds - MARGIN
            if first is not None:
                wanted &= (asked["first"][:, pivot] if pivot != NO_PIVOT else False) == first
            who = np.flatnonzero(wanted)
            if all_counts is not None and first is not True:
                all_counts.add(len(matrix))
            if not len(who):
                continue
            made = vectors_of(batch, values, known, low, high)
            if known is not None and angles.shape[1]:
                who = who[weights[who] @ np.abs(made).max(axis=0) >= best.thresholds[who] - MARGIN]
                if not len(who):
                    continue
            if counts is not None:
                counts.add(len(who))
            scores = np.round(matrix[who] @ made.T, DIGITS) + 0.0
            texts = np.array(names.slice(low, high - low).to_pylist(), object)
            if exclude_self:
                for col, name in enumerate(texts):
                    at = place.get(name)
                    if at is not None:
                        scores[who == at, col] = -np.inf
            best.offer(who, texts, scores)
    if best.kept:
        query, name, score = best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(name, pa.string()), pa.array(score)],
                                         ["query", "cand_table", "score"])


def _asked(block: DataFrame, layout: Layout, k: int) -> dict:
    """A block of queries as plain arrays: names, matrix, angles to the pivots, the pivots of the first round."""
    taken = block.toArrow()
    names = np.array(taken.column("query_table").to_pylist(), object)
    matrix, known = _matrix(taken, layout.values)
    pivots, pivot_dims = layout.pivots["matrix"], layout.pivots["known"]
    if not len(pivots):
        angles = np.zeros((len(names), 0))
    elif known is None:
        angles = _angles(matrix @ pivots.T)
    else:
        shared, mine, theirs = np.intersect1d(known, pivot_dims, return_indices=True)
        angles = _angles(matrix[:, mine] @ pivots[:, theirs].T)
    first = np.zeros(angles.shape, bool)
    if angles.shape[1]:
        near = np.argsort(angles, axis=1, kind="stable")
        held = np.array([layout.sizes.get(pivot, 0) for pivot in range(angles.shape[1])])[near]
        # one more than asked for, as the query itself may be among them
        needed = np.cumsum(held, axis=1) - held <= k
        np.put_along_axis(first, near, needed, axis=1)
    # queries without length score 0 with everything
    return {"names": names, "matrix": matrix, "known": known, "angles": angles, "first": first,
            "thresholds": np.full(len(names), -np.inf)}


def query_blocks(queries: DataFrame, values: list[str], n: int, by: tuple[str, ...] = ("query_table",)) -> list[DataFrame]:
    """The ``n`` queries cut by a hash into blocks whose matrices are small enough to broadcast."""
    if not n:
        return []
    if len(values) == 1:
        width = queries.agg(F.max(F.size(values[0]))).first()[0] or 1
    else:
        width = queries.select(F.explode(values[0]).alias("dim")).agg(F.count_distinct("dim")).first()[0] or 1
    blocks = math.ceil(n / max(1, min(QUERY_BLOCK, QUERY_CELLS // width)))
    if blocks == 1:
        return [queries]
    part = F.pmod(F.xxhash64(*by), F.lit(blocks))
    return [queries.filter(part == block) for block in range(blocks)]


def best_of_all(queries: DataFrame, candidates: DataFrame, values: list[str], k: int, exclude_self: bool = False,
                counts: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """``query_table, cand_table, score``: the best of every task; the k best of each query are among them.

    ``values`` names the column of a dense vector (of any length), or the columns of the dimensions and weights of
    a sparse one of length 1. Names are unique on both sides. ``counts`` gets how many products of a query and a block were made, and
    how many there are.
    """
    spark = queries.sparkSession
    n_candidates, n_queries = candidates.count(), queries.count()
    layout = laid_out(candidates, values, n_candidates, n_queries)
    made, possible = counts or (None, None)
    parts = []
    for block in query_blocks(queries.select("query_table", *values), values, n_queries):
        asked = _asked(block, layout, k)
        search = partial(_search, values=values, k=k, exclude_self=exclude_self, counts=made, all_counts=possible)
        found = []
        if layout.sizes:
            shared = spark.sparkContext.broadcast(asked)
            near = cut(layout.rows.mapInArrow(partial(search, shared=shared, first=True), FOUND))
            tops = near.groupBy("query").agg(F.slice(F.reverse(F.array_sort(F.collect_list("score"))), 1, k).alias("top"))
            for row in tops.filter(F.size("top") == k).select("query", F.element_at("top", -1).alias("kth")).collect():
                asked["thresholds"][row["query"]] = row["kth"]
            found.append(near)
        shared = spark.sparkContext.broadcast(asked)
        found.append(layout.rows.mapInArrow(partial(search, shared=shared, first=False if layout.sizes else None), FOUND))
        names = spark.createDataFrame(list(enumerate(asked["names"].tolist())), "query long, query_table string")
        parts.append(reduce(DataFrame.unionByName, found).join(F.broadcast(names), "query").select(
            "query_table", "cand_table", "score"))
    if not parts:
        return spark.createDataFrame([], "query_table string, cand_table string, score double")
    return reduce(DataFrame.unionByName, parts)


def _above(batches: Iterator[pa.RecordBatch], shared, values: list[str], keys: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    matrix, known = shared.value
    size = 8 * RING if known is None else max(1, min(RING, RING_CELLS // max(1, len(known))))
    weights = np.abs(matrix)
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            made = vectors_of(batch, values, known, low, min(batch.num_rows, low + size))
            who = np.arange(len(matrix))
            if known is not None:
                who = np.flatnonzero(weights @ np.abs(made).max(axis=0) > threshold - MARGIN)
            sims = matrix[who] @ made.T
            row, col = np.nonzero(sims > threshold)
            if len(row):
                places = pa.array(col + low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who[row]), *(batch.column(key).take(places) for key in keys), pa.array(sims[row, col])],
                    ["query", *keys, "sim"])


def all_above(queries: DataFrame, candidates: DataFrame, by_query: list[str], by_candidate: list[str], values: list[str],
              threshold: float) -> DataFrame:
    """``by_query, by_candidate, sim`` of all pairs whose cosine is above ``threshold``.

    Queries, kept by the caller, are broadcast in blocks; candidates stay where they lie, and only pairs above the
    threshold leave a task.
    """
    spark = queries.sparkSession
    kinds = dict(queries.dtypes + candidates.dtypes)
    keys = ", ".join(f"{name} {kinds[name]}" for name in by_candidate)
    parts = []
    for block in query_blocks(queries, values, queries.count(), tuple(by_query)):
        taken = block.toArrow()
        shared = spark.sparkContext.broadcast(_matrix(taken, values))
        found = candidates.select(*by_candidate, *values).mapInArrow(
            partial(_above, shared=shared, values=values, keys=by_candidate, threshold=threshold),
            f"query long, {keys}, sim double")
        own = taken.select(by_query).append_column("query", pa.array(range(taken.num_rows), pa.int64()))
        parts.append(found.join(F.broadcast(spark.createDataFrame(own)), "query").select(*by_query, *by_candidate, "sim"))
    if not parts:
        kept = ", ".join(f"{name} {kinds[name]}" for name in [*by_query, *by_candidate])
        return spark.createDataFrame([], f"{kept}, sim double")
    return reduce(DataFrame.unionByName, parts)
