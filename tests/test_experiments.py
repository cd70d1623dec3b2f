import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tablekin.plans import experiments
from tablekin.plans.experiments import Job, expand_grid
from tablekin.plans.ranking import full_params, rank_dense
from tablekin.plans.stored_vectors import refreshed_vectors
from tablekin.sources.result_store import ResultStore
from tablekin.sources.vector_store import VectorStore
from tests.helpers import gt_of, lake_of


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_default_grid():
    jobs = expand_grid()
    assert [j.method for j in jobs] == ["hash", "count", "tfidf", "encoder", "encoder", "encoder"]
    assert not any(j.embedding_params.get("names_only") and not j.embedding_params["include_names"]
                   for j in jobs)


def test_thresholds_belong_to_matching():
    grid = {"hash": {"embedding_params": {"n_features": [8, 16]},
                     "eval_params": {"agg": ["max", "None"], "threshold": [0.1, 0.2]}},
            "count": {"embedding_params": {}, "eval_params": {"agg": ["None"], "threshold": []}},
            "encoder": {"embedding_params": {"orientation": ["horizontal"]},
                        "eval_params": {"agg": ["mean", "None"], "threshold": [0.1]}}}
    jobs = expand_grid(grid)
    assert [(j.method, j.eval_params) for j in jobs] == 2 * [
        ("hash", {"agg": "max"}), ("hash", {"agg": "None", "threshold": 0.1}),
        ("hash", {"agg": "None", "threshold": 0.2})] + [("encoder", {"agg": "mean"})]
    assert expand_grid(grid, ["unknown"]) == []
    assert len(expand_grid(grid, ["hash"], limit=1)) == 3
    assert expand_grid(grid, ["hash"], limit=1) == expand_grid(grid, ["hash"], limit=1)


@pytest.fixture(scope="module")
def lake(spark):
    cells, meta = lake_of(spark, {
        ("lake", "colors"): {"c": ["red", "blue", "green"]},
        ("lake", "fruits"): {"c": ["apple", "pear", "plum"]},
        ("query", "q"): {"c": ["blue", "green", "black"]}})
    return cells, meta, gt_of(spark, {"q": ["colors"]})


def test_runs_are_recorded_and_vectors_reused(spark, lake, tmp_path):
    vectors, results = VectorStore(spark, f"{tmp_path}/v"), ResultStore(f"{tmp_path}/r")
    hashed = {"sample_size": 10, "n_features": 64}
    jobs = [Job("hash", hashed, {"agg": "max"}), Job("hash", hashed, {"agg": "mean"}),
            Job("hash", hashed, {"agg": "None"}), Job("hash", hashed, {"agg": "median"}),
            Job("encoder", {"sample_size": 5}, {"agg": "mean"}),
            Job("encoder", {"sample_size": 5}, {"agg": "None", "threshold": 0.1})]
    experiments.run_jobs(spark, "b", *lake, jobs, vectors, results, k=2, exclude_self=True)
    runs = {(r["method"], r["eval_params"]["agg"]): r for r in results.runs(spark).collect()}
    assert {key: r["status"] for key, r in runs.items()} == {
        ("hash", "max"): "completed", ("hash", "mean"): "completed",
        ("hash", "None"): "evaluation_skipped", ("hash", "median"): "failed",
        ("encoder", "mean"): "completed", ("encoder", "None"): "completed"}
    assert runs[("hash", "max")]["offline"] > 0 and runs[("hash", "mean")]["offline"] == 0
    assert [m["p"] for m in runs[("hash", "max")]["metrics"]] == [1.0, 0.5]
    assert "median" in runs[("hash", "median")]["error"]
    details = spark.read.json(f"{tmp_path}/r/details")
    assert details.select("run_id").distinct().count() == 4
    assert details.filter("list = 'ground_truth'").count() == 4
    loaded, n_built = refreshed_vectors(vectors, "b", "hash", hashed, *lake[:2])
    assert n_built == 0 and set(loaded.columns) == {"side", "table_name", "col_pos", "dim", "weight"}
    assert vectors.load("b", "hash", {"other": 1}) is None


class Constant:
    """An encoder of one number of dimensions."""

    def __init__(self, dim):
        self.dim = dim

    def __call__(self):
        return lambda texts: np.ones((len(texts), self.dim))


def test_stores_tell_lakes_encoders_and_runs_apart(spark, lake, tmp_path):
    vectors, results = VectorStore(spark, f"{tmp_path}/v"), ResultStore(f"{tmp_path}/r")
    jobs = [Job("hash", {"n_features": 64}, {"agg": "max"})]
    other = lake_of(spark, {("lake", "shapes"): {"s": ["round", "square"]}, ("query", "p"): {"s": ["round", "flat"]}})
    args = (jobs, vectors, results)
    experiments.run_jobs(spark, "one", *lake, *args, k=2)
    experiments.run_jobs(spark, "one", *lake, *args, k=1)
    experiments.run_jobs(spark, "two", *other, gt_of(spark, {"p": ["shapes"]}), *args, k=2)
    experiments.run_jobs(spark, "three", *other, gt_of(spark, {"gone": ["shapes"]}), *args, k=2)
    runs = results.runs(spark).collect()
    assert sorted((r["benchmark"], r["status"]) for r in runs) == [
        ("one", "completed"), ("one", "completed"), ("three", "no_valid_queries"), ("two", "completed")]
    assert len({r["run_id"] for r in runs}) == 4
    assert [r["offline"] == 0 for r in runs if r["benchmark"] == "two"] == [False]
    details = spark.read.json(f"{tmp_path}/r/details")
    assert {tuple(r) for r in details.select("benchmark", "query_table").distinct().collect()} == {
        ("one", "q"), ("two", "p")}
    for dim in (2, 3):
        experiments.run_jobs(spark, "one", *lake, [Job("encoder", {}, {"agg": "mean"})], vectors, results,
                             encoder=Constant(dim))
        stored, n_built = refreshed_vectors(vectors, "one", "encoder", {}, *lake[:2], Constant(dim))
        assert n_built == 0 and len(stored.first()["vec"]) == dim


def test_unfinished_vectors_are_not_used(spark, lake, tmp_path):
    vectors, params = VectorStore(spark, str(tmp_path)), {"a": 1}
    frame = spark.createDataFrame([("lake", "t", 1)], "side string, table_name string, dim int")
    vectors.save(frame, "one", "hash", params)
    assert vectors.load("one", "hash", params).count() == 1
    vectors._declare(vectors.path("one", "hash", params), "one", params, "started")
    assert vectors.load("one", "hash", params) is None


def test_a_failing_result_store_does_not_stop_jobs(spark, lake, tmp_path):
    class Broken(ResultStore):
        def append(self, *args, **named):
            raise OSError("full")

    vectors = VectorStore(spark, str(tmp_path))
    jobs = [Job("hash", {"n_features": n}, {"agg": "max"}) for n in (16, 32)]
    with pytest.warns(UserWarning, match="full"):
        experiments.run_jobs(spark, "one", *lake, jobs, vectors, Broken("nowhere"))
    assert all(vectors.table_versions("one", "hash", full_params("hash", job.embedding_params)) for job in jobs)


def test_a_stopped_run_goes_on_without_second_records(spark, lake, tmp_path):
    class Stopped(ResultStore):
        calls = 0

        def _write(self, frame, record, name):
            self.calls += 1
            if self.calls == 4:  # the second job's details are there, its record is not
                raise KeyboardInterrupt
            super()._write(frame, record, name)

    vectors = VectorStore(spark, f"{tmp_path}/v")
    jobs = [Job("hash", {"n_features": 64}, {"agg": agg}) for agg in ("max", "mean", "median", "sum")] + [
        Job("count", {}, {"agg": "max"})]
    with pytest.raises(KeyboardInterrupt):
        experiments.run_jobs(spark, "b", *lake, jobs, vectors, Stopped(str(tmp_path)), k=2, run="named")
    results = ResultStore(str(tmp_path))
    assert len(results.finished(spark, "named")) == 1
    first = results.runs(spark).first()
    for workers in (1, 3):  # the second time only the failed job is tried again
        assert experiments.run_jobs(spark, "b", *lake, jobs, vectors, results, k=2, run="named", workers=workers) == "named"
    runs = results.runs(spark).collect()
    assert sorted((r["method"], r["eval_params"]["agg"], r["status"]) for r in runs) == [
        ("count", "max", "completed"), ("hash", "max", "completed"), ("hash", "mean", "completed"),
        ("hash", "median", "failed"), ("hash", "sum", "completed")]
    assert first in runs and len(results.finished(spark, "named")) == 4
    details = results.details(spark)
    assert details.count() == details.distinct().count() and details.select("run_id").distinct().count() == 4
    assert results.finished(spark, "other") == set()


def test_jobs_at_once_build_equal_vectors_once(spark, lake, tmp_path):
    vectors, results = VectorStore(spark, f"{tmp_path}/v"), ResultStore(f"{tmp_path}/r")
    jobs = [Job(method, {}, {"agg": agg}) for method in ("count", "tfidf") for agg in ("max", "mean", "sum")]
    experiments.run_jobs(spark, "b", *lake, jobs, vectors, results, k=2, workers=4)
    runs = results.runs(spark).collect()
    assert len(runs) == 6 and {r["status"] for r in runs} == {"completed"}
    for method in ("count", "tfidf"):
        assert sum(r["offline"] > 0 for r in runs if r["method"] == method) >= 1
        full = full_params(method, {})
        assert vectors.table_versions("b", method, full).select("version").distinct().count() == 1
        assert len(list((tmp_path / "v").glob(f"*/method={method}/*/vectors/version=*"))) == 1


def test_only_query_tables_are_asked_and_a_sample_of_them(lake, spark):
    cells, meta, gt = lake
    job = Job("hash", {"n_features": 64}, {"agg": "max"})
    more = gt.union(gt_of(spark, {"fruits": ["nothing"]}))
    assert sorted(map(tuple, experiments.grid_metrics(cells, meta, more, [job], 2).drop("params").collect())) == sorted(
        map(tuple, experiments.grid_metrics(cells, meta, gt, [job], 2).drop("params").collect()))
    assert experiments.grid_metrics(cells, meta, gt, [job], 2, n_queries=1).count() == 2
    assert experiments.grid_metrics(cells, meta, gt, [job], 2, n_queries=0).count() == 0


def test_dense_matching_leaves_out_negative_cosines(spark):
    rows = [("lake", "a", 0, [1.0, 0.0]), ("lake", "a", 1, [0.0, 1.0]), ("lake", "b", 0, [-1.0, 0.0]), ("lake", "z", 0, [0.0, 0.0]),
            ("query", "q", 0, [0.9, 0.1]), ("query", "q", 1, [0.8, 0.6]), ("lake", "q", 0, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "side string, table_name string, unit_id long, vec array<double>")
    gt = gt_of(spark, {"q": ["a"]})
    ranked = rank_dense(vectors, gt, "None", 4, True, 0.1).collect()
    assert [(r["cand_table"], r["score"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [
        ("a", pytest.approx(0.993884 + 0.6, abs=1e-6)), ("z", 0.0), ("b", 0.0)]
    with pytest.raises(ValueError):
        rank_dense(vectors, gt, "None", 4)


@pytest.mark.parametrize("params", [
    {"orientation": "horizontal"}, {"orientation": "horizontal", "names_only": True},
    {"names_only": True}, {"include_names": False, "deduplicate": False}])
def test_encoder_modes(lake, params):
    got = experiments.grid_metrics(*lake, [Job("encoder", params, {"agg": "mean"})], 2)
    assert got.count() == 2


def test_invalid_names_only(lake):
    with pytest.raises(ValueError):
        experiments.grid_metrics(*lake, [Job("encoder", {"names_only": True, "include_names": False},
                                             {"agg": "mean"})])
