"""Hard negatives of anchors: rows of another label that score close below a positive.

Entries become whole numbers, floor(256 * c), and a score is an exact inner product. The positives of an
anchor are its best other rows of the same label; for each of them, the negatives are the best rows of
other labels that score at most as high and at least 80 % as high. Higher scores come first, ties go to the smaller
vec_id. Scores come from Strassen products of anchor tiles with candidate tiles.

Anchors are taken in blocks of bounded size, which are broadcast; candidates stay where they lie. Two scans
serve a block: the first keeps a heap of positives per anchor in each task, the second a
heap per anchor and positive of what falls into its window. Only heaps are shuffled, and merged. So work
grows with anchors times rows, as the task does, memory with a block, and nothing is left out.

Rows with a null vec_id, label, vector or entry, or an entry that is not finite, take no part; nor do
rows with max|x| * sqrt(length) of 2^31 or more, whose scores may not fit a long. Rows equal in vec_id,
label and vector count once; other rows that share a vec_id are rows of their own. Shorter
vectors are filled up with zeros. Rows of another name than these three are ignored. Without anchors the result is empty.
"""

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekin.llm.common import shared_folder, shipped, stage
from tablekin.llm.strassen import inner_products
from tablekin.llm.vectors import finite, largest, matrix, whole

shipped(__name__)

# anchors, and entries of their vectors, that are broadcast at once
BLOCK_ANCHORS, BLOCK_ENTRIES = 16_384, 4_000_000
ANCHOR_TILE, CANDIDATE_TILE = 512, 2_048
LOWEST = -(2**63) + 1
LAST_ID = 2**63 - 1
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
          "negative_score long, positive_rank int")


class Heaps:
    """The ``size`` best (score, id) of each of ``n`` owners; higher scores first, then smaller ids."""

    def __init__(self, n: int, size: int):
        self.scores = np.full((n, size), LOWEST, np.int64)
        self.ids = np.full((n, size), LAST_ID, np.int64)

    def offer(self, owners: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Merges a tile, owners by candidates in order of their ids; only ``allowed`` places count."""
        size = self.scores.shape[1]
        masked = np.where(allowed, scores, LOWEST)
        keep = min(size, masked.shape[1])
        border = np.partition(masked, masked.shape[1] - keep, axis=1)[:, masked.shape[1] - keep, None]
        above, level = masked > border, (masked == border) & (border > LOWEST)
        room = keep - above.sum(axis=1, keepdims=True)
        row, col = np.nonzero(above | level & (np.cumsum(level, axis=1, dtype=np.int32) <= room))
        if not len(row):
            return
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        fresh_scores = np.full((len(masked), size), LOWEST, np.int64)
        fresh_ids = np.full((len(masked), size), LAST_ID, np.int64)
        fresh_scores[row, place], fresh_ids[row, place] = masked[row, col], ids[col]
        both = np.hstack([self.scores[owners], fresh_scores]), np.hstack([self.ids[owners], fresh_ids])
        order = np.lexsort((both[1], -both[0]), axis=1)[:, :size]
        self.scores[owners], self.ids[owners] = (np.take_along_axis(side, order, axis=1) for side in both)

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owners, scores and ids of all that is kept."""
        owner, place = np.nonzero(self.scores > LOWEST)
        return owner, self.scores[owner, place], self.ids[owner, place]


def tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Candidates in tiles, each in order of vec_id: ids, labels, keys, vectors."""
    for batch in batches:
        ids, labels, keys = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("vec_id", "label", "row_key"))
        vectors = matrix(batch.column("x"), width)
        order = np.argsort(ids, kind="stable")
        for low in range(0, len(order), CANDIDATE_TILE):
            part = order[low:low + CANDIDATE_TILE]
            yield ids[part], labels[part], keys[part], vectors[part]


def scored(batches: Iterator[pa.RecordBatch], anchors: dict) -> Iterator[tuple]:
    """All tile products: the anchors' slice, scores, equal labels, candidates' ids and keys."""
    for ids, labels, keys, vectors in tiles(batches, anchors["x"].shape[1]):
        for low in range(0, len(anchors["id"]), ANCHOR_TILE):
            owners = slice(low, low + ANCHOR_TILE)
            yield (owners, inner_products(anchors["x"][owners], vectors),
                   anchors["label"][owners, None] == labels[None, :], ids, keys)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values) for values in columns.values()], list(columns))


def positive_heaps(batches: Iterator[pa.RecordBatch], shared, size: int) -> Iterator[pa.RecordBatch]:
    """Each task's best rows of the same label for every anchor of the block."""
    anchors = shared.value
    heaps = Heaps(len(anchors["id"]), size)
    for owners, scores, same, ids, keys in scored(batches, anchors):
        row, col = np.nonzero(anchors["key"][owners, None] == keys[None, :])
        own = anchors["id"][owners][row] == ids[col]
        same[row[own], col[own]] = False
        heaps.offer(owners, scores, same, ids)
    owner, score, found = heaps.kept()
    yield _batch(anchor=owner, score=score, vec_id=found)


def window_heaps(batches: Iterator[pa.RecordBatch], shared, size: int, least: int) -> Iterator[pa.RecordBatch]:
    """Each task's best rows of other labels in the window of every positive of the block.

    A window reaches from ``least`` percent of the positive's score up to that score.
    """
    anchors = shared.value
    tops = anchors["positives"]
    # least * top <= 100 * score in whole numbers, without products that could overflow
    short = 100 - least
    floors = tops - (tops // 100 * short + tops % 100 * short // 100)
    heaps = [Heaps(len(tops), size) for _ in range(tops.shape[1])]
    for owners, scores, same, ids, _ in scored(batches, anchors):
        for place, heap in enumerate(heaps):
            top, floor = tops[owners, place, None], floors[owners, place, None]
            heap.offer(owners, scores, ~same & (scores <= top) & (scores >= floor) & (top > LOWEST), ids)
    for place, heap in enumerate(heaps):
        owner, score, found = heap.kept()
        yield _batch(anchor=owner, place=np.full(len(owner), place, np.int64), score=score, vec_id=found)


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part, each once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("e"))
    fitting = largest(F.col("e")) * F.sqrt(F.size("e").cast("double")) < float(2**31)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("e"))).filter(
        fitting).select("vec_id", "label", whole(F.col("e")).alias("x")).distinct()


def _merged(heaps: DataFrame, owner: list[str], size: int) -> DataFrame:
    """The best of all tasks' heaps, numbered from 1 in ``rank``; a task sends ``size`` rows per owner at most."""
    order = Window.partitionBy(*owner).orderBy(F.col("score").desc(), "vec_id")
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def _of_block(rows: DataFrame, block: DataFrame, width: int, positives: int, negatives: int, least: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    taken = block.toArrow()
    anchors = {"id": taken.column("vec_id").to_numpy(), "label": taken.column("label").to_numpy(),
               "key": taken.column("row_key").to_numpy(), "x": matrix(taken.column("x"), width)}
    first = rows.mapInArrow(partial(positive_heaps, shared=context.broadcast(anchors), size=positives),
                            "anchor long, score long, vec_id long")
    best = _merged(first, ["anchor"], positives).toArrow()
    at = best.column("anchor").to_numpy(), best.column("rank").to_numpy() - 1
    tops = np.full((len(anchors["id"]), positives), LOWEST, np.int64)
    tops[at] = best.column("score").to_numpy()
    names = np.full(tops.shape, LAST_ID, np.int64)
    names[at] = best.column("vec_id").to_numpy()
    second = rows.mapInArrow(
        partial(window_heaps, shared=context.broadcast(anchors | {"positives": tops}), size=negatives, least=least),
        "anchor long, place long, score long, vec_id long")
    known = rows.sparkSession.createDataFrame(pa.table({
        "anchor": at[0], "place": at[1].astype(np.int64), "anchor_id": anchors["id"][at[0]], "positive_id": names[at],
        "positive_score": tops[at]}))
    return _merged(second, ["anchor", "place"], negatives).join(F.broadcast(known), ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), (F.col("place") + 1).cast("int").alias("positive_rank"))


def mine(vectors: DataFrame, anchors: Column | str, positives: int = 5, negatives: int = 5, least: int = 80,
         block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """Hard negatives of the rows for which ``anchors``, a condition on vec_id and label, holds.

    ``vec_id, label, embedding`` come in; out come ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score`` and ``positive_rank``, up to ``negatives`` rows for each of up to
    ``positives`` positives, whose scores are at least ``least`` percent of the positive's.
    """
    spark = vectors.sparkSession
    # many files, as every row costs a product with all anchors
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(prepared(vectors).withColumn("row_key", F.xxhash64("vec_id", "label", "x")).repartition(files))
    asked = rows.filter(anchors)
    n, width = asked.count(), max(rows.agg(F.max(F.size("x"))).first()[0] or 1, 1)
    blocks = math.ceil(n / max(1, min(block_anchors, BLOCK_ENTRIES // width)))
    if not blocks:
        return spark.createDataFrame([], RESULT)
    made = (_of_block(rows, asked.filter(F.pmod("row_key", F.lit(blocks)) == block), width, positives, negatives, least)
            for block in range(blocks))
    if blocks == 1:
        return next(made)
    folder = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    for block, result in enumerate(made):
        result.write.parquet(f"{folder}/block={block}")
    return spark.read.schema(RESULT).parquet(*[f"{folder}/block={block}" for block in range(blocks)])
