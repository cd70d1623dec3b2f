import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekin.operators import pruned, search
from tablekin.operators.pooling import dense_table_vectors
from tablekin.plans.ranking import rank_dense, rank_sparse, sparse_vectors
from tablekin.schema import LAKE, MARK
from tests.helpers import gt_of, lake_of, rows

VECTOR = "side string, table_name string, col_pos int, dim int, weight double"


def marked(*entries):
    columns = {entry[:3] for entry in entries}
    return [*entries, *[(*column, MARK, 0.0) for column in columns]]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(marked(
        ("lake", "a", 0, 1, 1.0), ("lake", "b", 0, 1, 0.6), ("lake", "b", 0, 2, 0.8),
        ("lake", "z", 0, 3, 1.0), ("lake", "y", 0, 4, 1.0), ("lake", "empty", 0, MARK, 0.0),
        ("query", "a", 0, 2, 1.0), ("query", "q", 0, 1, 1.0)), VECTOR).dropDuplicates()


def test_query_copy_replaces_lake_copy_and_zeros_fill_up(spark, vectors):
    ranked = rank_sparse(vectors, gt_of(spark, {"q": ["a"], "gone": ["a"]}), "max", 4)
    assert rows(ranked, "rank", "cand_table", "score") == [
        (1, "q", 1.0), (2, "b", 0.6), (3, "a", 0.0), (4, "empty", 0.0)]


def test_own_table_left_out(spark, vectors):
    ranked = rank_sparse(vectors, gt_of(spark, {"a": ["b"]}), "max", 3, exclude_self=True)
    assert rows(ranked, "rank", "cand_table", "score") == [
        (1, "b", 0.8), (2, "empty", 0.0), (3, "q", 0.0)]


def test_matching_takes_lake_candidates_and_own_query_columns(spark, vectors):
    ranked = rank_sparse(vectors, gt_of(spark, {"a": ["b"]}), "None", 6, threshold=0.1)
    assert rows(ranked, "rank", "cand_table", "score") == [
        (1, "b", 0.8), (2, "z", 0.0), (3, "y", 0.0), (4, "q", 0.0), (5, "empty", 0.0),
        (6, "a", 0.0)]
    assert rows(search.candidate_pool(vectors, LAKE).filter("table_name = 'a'"), "side") == [
        ("lake",)]


def test_blocks_and_partitions_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(1)
    entries = [("lake" if t % 3 else "query", f"t{t:02d}", 0, int(d), float(rng.random()))
               for t in range(40) for d in rng.choice(30, 6, replace=False)]
    frame = spark.createDataFrame(marked(*entries), VECTOR)
    gt = gt_of(spark, {f"t{t:02d}": ["t00"] for t in range(40)})
    pooled = search.pool_vectors(frame.drop("col_pos"))
    queries = search.valid_queries(gt, search.pool_names(pooled))
    once = search.cosine_pairs(pooled, queries)
    monkeypatch.setattr(search, "BLOCK_ENTRIES", 35)
    blocked = search.cosine_pairs(pooled.repartition(5), queries)
    assert rows(once, *once.columns) == rows(blocked, *once.columns)
    matrix = np.zeros((40, 30))
    for _, name, _, d, w in entries:
        matrix[int(name[1:]), d] = w
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    cosines = matrix @ matrix.T
    for row in once.collect():
        assert row["score"] == pytest.approx(
            cosines[int(row["query_table"][1:]), int(row["cand_table"][1:])], abs=1e-6)
    assert once.count() == int((cosines > 0).sum())
    whole = search.pooled_top_k(pooled, gt, 7, True)
    monkeypatch.setattr(pruned, "QUERY_BLOCK", 9)
    monkeypatch.setattr(pruned, "RING", 4)
    monkeypatch.setattr(pruned, "RING_CELLS", 70)
    small = search.pooled_top_k(pooled, gt, 7, True)
    assert rows(small, *small.columns) == rows(whole, *whole.columns)
    scores = np.round(cosines, 6)
    best = {(f"t{q:02d}", f"t{c:02d}", rank + 1) for q in range(40) for rank, c in enumerate(
        sorted((c for c in range(40) if c != q), key=lambda c: (-scores[q, c], c))[:7])}
    assert {(r["query_table"], r["cand_table"], r["rank"]) for r in whole.collect()} == best


def test_blocks_bound_what_is_broadcast(spark, monkeypatch):
    frame = spark.range(1000).withColumnRenamed("id", "query_table")
    assert len(search.query_blocks(frame, ["query_table"])) == 1
    monkeypatch.setattr(search, "BLOCK_ENTRIES", 100)
    sizes = [block.count() for block in search.query_blocks(frame, ["query_table"])]
    assert len(sizes) == 10 and sum(sizes) == 1000


@pytest.mark.parametrize("exclude_self", [False, True])
def test_dense_search_by_brute_force(spark, monkeypatch, exclude_self):
    monkeypatch.setattr(pruned, "QUERY_BLOCK", 11)
    monkeypatch.setattr(pruned, "RING", 4)
    rng = np.random.default_rng(2)
    vecs = np.round(rng.normal(size=(60, 5)), 1)
    vecs[7] = 0
    vecs[20:40] = vecs[3]  # a third of all are copies
    frame = spark.createDataFrame([(f"v{i:02d}", v.tolist()) for i, v in enumerate(vecs)],
                                  "query_table string, vec array<double>")
    got = search.dense_top_k(frame, frame.withColumnRenamed("query_table", "cand_table"), 6,
                             exclude_self).collect()
    length = np.linalg.norm(vecs, axis=1, keepdims=True)
    unit = np.divide(vecs, length, out=np.zeros_like(vecs), where=length > 0)
    scores = np.round(unit @ unit.T, 6)
    expected = set()
    for q in range(60):
        order = sorted((c for c in range(60) if not exclude_self or c != q),
                       key=lambda c: (-scores[q, c], c))[:6]
        expected |= {(f"v{q:02d}", f"v{c:02d}", i + 1) for i, c in enumerate(order)}
    assert {(r["query_table"], r["cand_table"], r["rank"]) for r in got} == expected


def test_dense_pooling_keeps_signs(spark):
    frame = spark.createDataFrame(
        [("lake", "t", [1.0, -2.0]), ("lake", "t", [-3.0, -4.0])],
        "side string, table_name string, vec array<double>")
    for agg, expected in (("max", [1.0, -2.0]), ("mean", [-1.0, -3.0]), ("sum", [-2.0, -6.0])):
        assert dense_table_vectors(frame, agg).first()["vec"] == expected
    ranked = rank_dense(frame, gt_of(spark, {"t": ["t"]}), "mean", 3)
    assert rows(ranked, "cand_table", "score") == [("t", 1.0)]


@pytest.mark.parametrize("method", ["hash", "count", "tfidf"])
@pytest.mark.parametrize("agg", ["max", "mean", "sum"])
def test_slices_find_each_other(spark, method, agg):
    cells, meta = lake_of(spark, {
        ("lake", "colors"): {"c": ["red", "blue", "green"], "n": [1, 2, 3]},
        ("lake", "fruits"): {"c": ["apple", "pear", "plum"], "n": [4, 5, 6]},
        ("query", "q"): {"c": ["blue", "green", "black"]}})
    params = {"include_column_names": False}
    ranked = rank_sparse(sparse_vectors(cells, meta, method, params),
                         gt_of(spark, {"q": ["colors"]}), agg, 2, exclude_self=True)
    assert ranked.orderBy("rank").first()["cand_table"] == "colors"
    assert ranked.filter(F.col("score") < 0).count() == 0
