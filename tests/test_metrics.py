import pytest

from tablekin.operators.metrics import (
    metrics_at_k,
    metrics_per_query,
    ranking_detail,
    running_hits,
)
from tests.helpers import gt_of

EXPECTED = [
    (1, 1, 1 / 3, 0.5, 1), (2, 0.5, 1 / 3, 0.4, 0.5), (3, 2 / 3, 2 / 3, 2 / 3, 5 / 9),
    (4, 0.5, 2 / 3, 4 / 7, 5 / 9), (5, 0.5, 2 / 3, 4 / 7, 5 / 9)]


@pytest.fixture(scope="module")
def frames(spark):
    ranked = spark.createDataFrame(
        [("a", c, 1.0 - i / 10, i + 1) for i, c in enumerate("bxcy")],
        "query_table string, cand_table string, score double, rank int")
    return ranked, gt_of(spark, {"a": ["a", "b", "c"]})


def test_every_cutoff(frames):
    got = sorted(tuple(r)[1:] for r in metrics_per_query(*frames, k=5).collect())
    for line, expected in zip(got, EXPECTED, strict=True):
        assert line == pytest.approx(expected)


def test_means_and_hits(frames):
    means = metrics_at_k(metrics_per_query(*frames, k=2)).orderBy("cutoff").collect()
    assert [m["map"] for m in means] == [1.0, 0.5]
    hits = running_hits(*frames).orderBy("rank").collect()
    assert [(h["hit"], h["hits"]) for h in hits] == [(1, 1), (0, 1), (1, 2), (0, 2)]


def test_detail(frames):
    told = sorted((r["list"], r["position"], r["table_name"]) for r in ranking_detail(*frames).collect())
    assert [name for kind, _, name in told if kind == "candidates"] == ["b", "x", "c", "y"]
    assert [name for kind, _, name in told if kind == "ground_truth"] == ["a", "b", "c"]
    assert {position for _, position, _ in told} == {1, 2, 3, 4}


def test_query_without_relevant_tables_scores_zero(spark, frames):
    ranked, _ = frames
    got = metrics_per_query(ranked, gt_of(spark, {"a": [None]}), 3).collect()
    assert {(r["p"], r["r"], r["f1"], r["ap"]) for r in got} == {(0.0, 0.0, 0.0, 0.0)}


def test_recall_never_falls(frames):
    got = metrics_per_query(*frames, k=5).orderBy("cutoff").collect()
    recalls = [r["r"] for r in got]
    assert recalls == sorted(recalls)
