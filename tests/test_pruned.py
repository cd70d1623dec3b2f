"""Pruned search: the same best as over all pairs, with most products left out where vectors form groups."""

import numpy as np
import pytest

from tablekin.operators import pruned, search


def best(names, asked, scores, k, exclude_self):
    expected = set()
    for row, name in enumerate(asked):
        order = sorted((c for c in range(len(names)) if not exclude_self or names[c] != name),
                       key=lambda c: (-scores[row, c], names[c]))[:k]
        expected |= {(name, names[c], rank + 1, scores[row, c]) for rank, c in enumerate(order)}
    return expected


def grouped(n, groups, width, seed, spread=0.05):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(groups, width))
    return centres[random.integers(groups, size=n)] + spread * random.normal(size=(n, width))


def small(monkeypatch, ring=16):
    for name, value in (("PIVOTS", 20), ("PER_PIVOT", 10), ("PER_ASKED", 1), ("FEWEST", 2), ("RING", ring)):
        monkeypatch.setattr(pruned, name, value)


def counted(spark, queries, candidates, values, k, exclude_self=False):
    context = spark.sparkContext
    counts = context.accumulator(0), context.accumulator(0)
    ranked = search.top_k(pruned.best_of_all(queries, candidates, values, k, exclude_self, counts), k).collect()
    return {(r["query_table"], r["cand_table"], r["rank"], r["score"]) for r in ranked}, counts[0].value / counts[1].value


@pytest.mark.parametrize("exclude_self", [False, True])
def test_dense_search_leaves_out_what_cannot_matter(spark, monkeypatch, exclude_self):
    small(monkeypatch)
    monkeypatch.setattr(pruned, "QUERY_BLOCK", 45)
    vectors = grouped(900, 15, 12, 1)
    vectors[300:500] = vectors[7]  # copies: ties by name
    vectors[11] = 0
    vectors[12] = -vectors[7]
    names = [f"v{n:04d}" for n in range(len(vectors))]
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vectors)], "cand_table string, vec array<double>")
    asked = [*range(0, 80), 310]
    queries = frame.filter(frame["cand_table"].isin([names[q] for q in asked])).withColumnRenamed("cand_table", "query_table")
    got, share = counted(spark, queries, frame.repartition(6), ["vec"], 7, exclude_self)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    assert got == best(names, [names[q] for q in asked], np.round(unit[asked] @ unit.T, 6) + 0.0, 7, exclude_self)
    assert share < 0.4


def test_sparse_search_leaves_out_what_cannot_matter(spark, monkeypatch):
    small(monkeypatch)
    monkeypatch.setattr(pruned, "RING_CELLS", 2_000)
    random = np.random.default_rng(4)
    matrix = np.zeros((600, 90))
    for row in range(600):
        own = 6 * (row % 12)  # a topic's terms, and some that all use
        matrix[row, own:own + 6] = random.random(6) + 0.2
        matrix[row, random.choice(np.arange(72, 90), 3)] = 0.2 * random.random(3)
    matrix[40] = 0
    matrix[100:160] = matrix[12]
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
    names = [f"t{n:03d}" for n in range(600)]
    rows = [(n, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for n, v in zip(names, matrix)]
    frame = spark.createDataFrame(rows, "cand_table string, dims array<int>, weights array<double>")
    queries = frame.filter("cand_table < 't055'").withColumnRenamed("cand_table", "query_table")
    got, share = counted(spark, queries, frame, ["dims", "weights"], 5, True)
    expected = best(names, names[:55], np.round(matrix[:55] @ matrix.T, 6) + 0.0, 5, True)
    assert {r[:3] for r in got} == {r[:3] for r in expected}
    assert share < 0.4


def test_candidates_are_shuffled_once(spark, monkeypatch):
    small(monkeypatch)
    frame = spark.createDataFrame([(f"v{n}", v.tolist()) for n, v in enumerate(grouped(200, 5, 4, 2))],
                                  "cand_table string, vec array<double>")
    found = pruned.best_of_all(frame.withColumnRenamed("cand_table", "query_table").limit(9), frame, ["vec"], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("n", [0, 1, 60])
def test_few_rows(spark, monkeypatch, n):
    small(monkeypatch)
    frame = spark.createDataFrame([(f"v{i:02d}", [1.0, 0.0]) for i in range(n)], "cand_table string, vec array<double>")
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0])], "query_table string, vec array<double>")
    got, _ = counted(spark, queries, frame, ["vec"], 4) if n else (set(search.dense_top_k(queries, frame, 4).collect()), 0)
    assert got == {(q, f"v{i:02d}", i + 1, score) for q, score in (("q", 1.0), ("z", 0.0)) for i in range(min(n, 4))}
    assert search.dense_top_k(queries.limit(0), frame, 4).collect() == []
