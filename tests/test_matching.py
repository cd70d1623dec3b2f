import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablekin.functions.assignment import best_alignment, upper_bound
from tablekin.operators.matching import bipartite_candidates, bipartite_scores


def by_trying_all(w: np.ndarray) -> float:
    w = w if w.shape[0] <= w.shape[1] else w.T
    return max(sum(w[i, c] for i, c in enumerate(cols))
               for cols in itertools.permutations(range(w.shape[1]), w.shape[0]))


@given(st.integers(1, 5), st.integers(1, 6), st.randoms(use_true_random=False))
@settings(max_examples=200, deadline=None)
def test_alignment_is_the_best_of_all(n, m, random):
    w = np.array([[random.choice([0, random.random()]) for _ in range(m)] for _ in range(n)])
    best = best_alignment(w)
    assert best == pytest.approx(by_trying_all(w))
    assert upper_bound(w) >= best - 1e-12


def edges(spark, *rows):
    return spark.createDataFrame(
        [("q", i, c, j, s) for c, i, j, s in rows],
        "query_table string, query_col int, cand_table string, cand_col int, sim double")


def test_scores(spark):
    frame = edges(spark, ("a", 0, 0, 0.9), ("a", 0, 1, 0.8), ("a", 1, 0, 0.7),
                  ("b", 0, 0, 0.4), ("b", 1, 0, 0.6))
    assert {r["cand_table"]: r["score"] for r in bipartite_scores(frame).collect()} == {
        "a": 1.5, "b": 0.6}


def test_unsolved_pairs_are_never_among_the_best(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{c:03d}", i, j, float(rng.random()))
            for c in range(120) for i in range(4) for j in range(4) if rng.random() < 0.6]
    frame = edges(spark, *rows).repartition(3)
    everything = {r["cand_table"]: r["score"] for r in bipartite_scores(frame).collect()}
    some = {r["cand_table"]: r["score"] for r in bipartite_candidates(frame, 5).collect()}
    best = sorted(everything.items(), key=lambda item: (-item[1], item[0]))[:5]
    assert dict(best).items() <= some.items()
    assert len(some) < len(everything)


@pytest.mark.parametrize("parts", [1, 9])
def test_what_is_solved_does_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(6)
    rows = [(f"c{c:03d}", i, j, 0.1 + 0.9 * float(rng.random()) * (c % 10 == 0 or 0.3)) for c in range(100)
            for i in range(3) for j in range(3)]
    solved = bipartite_candidates(edges(spark, *rows).repartition(parts), 4)
    assert 4 <= solved.count() == solved.dropDuplicates(["query_table", "cand_table"]).count() <= 20


def test_blocks_do_not_change_edges(spark, monkeypatch):
    from tablekin.operators import pruned
    from tablekin.operators.matching import column_pair_similarity
    rng = np.random.default_rng(4)
    entries = []
    for table in range(12):
        for col in range(3):
            w = rng.random(5)
            w /= np.linalg.norm(w)
            entries += [("lake", f"t{table:02d}", col, int(d), float(x))
                        for d, x in zip(rng.choice(20, 5, replace=False), w)]
    vectors = spark.createDataFrame(
        entries, "side string, table_name string, col_pos int, dim int, weight double")
    pool = vectors.select("table_name", "side").distinct()
    queries = pool.withColumnRenamed("table_name", "query_table")

    def found():
        return sorted((r["query_table"], r["query_col"], r["cand_table"], r["cand_col"],
                       round(r["sim"], 9))
                      for r in column_pair_similarity(vectors, queries, pool, 0.1).collect())

    once = found()
    monkeypatch.setattr(pruned, "QUERY_BLOCK", 5)
    monkeypatch.setattr(pruned, "RING_CELLS", 70)
    monkeypatch.setattr(pruned, "RING", 4)
    assert found() == once and len(once) > 36
    with pytest.raises(ValueError):
        column_pair_similarity(vectors, queries, pool, -0.5)
