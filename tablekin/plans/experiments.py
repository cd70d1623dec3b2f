"""Experiments: parameter grids, one search-and-score job per combination, and its records."""

import itertools
import time
import traceback
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from hashlib import md5
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.functions.frames import cut
from tablekin.operators.metrics import metrics_at_k, metrics_per_query, ranking_detail
from tablekin.operators.prep import keep_queries
from tablekin.operators.sampling import sample_front
from tablekin.operators.search import sample_queries, valid_queries
from tablekin.plans.ranking import (
    dense_vectors,
    full_params,
    rank_dense,
    rank_sparse,
    sparse_vectors,
    with_defaults,
)
from tablekin.plans.stored_vectors import refreshed_vectors
from tablekin.schema import QUERY
from tablekin.sources.result_store import ResultStore
from tablekin.sources.vector_store import VectorStore, table_prints

# The default grid. 'encoder' stands for a sentence encoder given by the user.
DEFAULT_GRID: dict[str, dict[str, dict[str, list]]] = {
    "hash": {
        "embedding_params": {"sample_size": [1000], "n_features": [4096],
                             "include_column_names": [False]},
        "eval_params": {"agg": ["max"], "threshold": []},
    },
    "count": {
        "embedding_params": {"sample_size": [1000], "max_features": [4096],
                             "ngram_range": [(1, 2)], "include_column_names": [False]},
        "eval_params": {"agg": ["max"], "threshold": []},
    },
    "tfidf": {
        "embedding_params": {"sample_size": [1000], "max_features": [4096],
                             "ngram_range": [(1, 2)], "include_column_names": [False]},
        "eval_params": {"agg": ["max"], "threshold": []},
    },
    "encoder": {
        "embedding_params": {"sample_size": [20], "orientation": ["vertical"],
                             "deduplicate": [True], "include_names": [True, False],
                             "names_only": [True, False]},
        "eval_params": {"agg": ["mean"], "threshold": [0.1]},
    },
}


@dataclass(frozen=True)
class Job:
    """One combination of a method's parameters and of how its vectors are searched."""

    method: str
    embedding_params: dict[str, Any] = field(default_factory=dict)
    eval_params: dict[str, Any] = field(default_factory=dict)

    def params(self) -> dict[str, str]:
        both = {**self.embedding_params, **self.eval_params, "method": self.method}
        return {key: str(value) for key, value in sorted(both.items())}


def combinations(lists: dict[str, list]) -> list[dict[str, Any]]:
    return [dict(zip(lists, values)) for values in itertools.product(*lists.values())]


def _valid_embedding(method: str, params: dict[str, Any]) -> bool:
    only_names = method == "encoder" and params.get("names_only", False)
    return not only_names or params.get("include_names", True)


def _eval_choices(params: dict[str, Any], grid: dict[str, list]) -> list[dict[str, Any]]:
    """Thresholds belong to matching, and rows of a table cannot be matched."""
    by_rows = params.get("orientation") == "horizontal"
    choices: list[dict[str, Any]] = []
    for agg in grid.get("agg", []):
        if agg != "None":
            choices.append({"agg": agg})
        elif not by_rows:
            choices += [{"agg": agg, "threshold": t} for t in grid.get("threshold", [])]
    return choices


def expand_grid(grid: dict[str, dict[str, dict[str, list]]] | None = None,
                methods: list[str] | None = None, limit: int | None = None) -> list[Job]:
    """All valid jobs of a grid; ``limit`` keeps so many embedding settings per method.

    The kept ones are the first in md5 order of their parameters, so the choice is random
    but the same each time. Unknown methods are left out.
    """
    grid = DEFAULT_GRID if grid is None else grid
    jobs: list[Job] = []
    for method in grid if methods is None else [m for m in methods if m in grid]:
        settings = combinations(grid[method].get("embedding_params", {}))
        if limit is not None and len(settings) > limit:
            settings = sorted(settings, key=param_hash)[:limit]
        for params in settings:
            if _valid_embedding(method, params):
                jobs += [Job(method, params, choice) for choice in _eval_choices(
                    params, grid[method].get("eval_params", {}))]
    return jobs


def param_hash(params: dict[str, Any]) -> str:
    return md5(str(sorted((k, str(v)) for k, v in params.items())).encode()).hexdigest()


def _vectors(cells: DataFrame, columns_meta: DataFrame, job: Job,
             encoder: Callable | None) -> DataFrame:
    if job.method == "encoder":
        return dense_vectors(cells, columns_meta, job.embedding_params, encoder)
    return sparse_vectors(cells, columns_meta, job.method, job.embedding_params)


def _ranking(vectors: DataFrame, gt: DataFrame, job: Job, k: int, exclude_self: bool) -> DataFrame:
    agg, threshold = job.eval_params["agg"], job.eval_params.get("threshold")
    rank = rank_dense if job.method == "encoder" else rank_sparse
    return rank(vectors, gt, agg, k, exclude_self, threshold)


def asked(gt: DataFrame, columns_meta: DataFrame) -> DataFrame:
    """The ground truth of the query tables; a lake table is no query because it is named as one."""
    return keep_queries(gt, columns_meta.filter(F.col("side") == QUERY).select("table_name"))


def _sampled(gt: DataFrame, vectors: DataFrame, n: int | None) -> DataFrame:
    """The ground truth of n of the queries that have a vector."""
    if n is None:
        return gt
    with_vector = valid_queries(gt, vectors.select("table_name").distinct())
    return gt.join(F.broadcast(sample_queries(with_vector, n)), "query_table", "left_semi")


def grid_metrics(cells: DataFrame, columns_meta: DataFrame, gt: DataFrame, jobs: list[Job],
                 k: int = 10, exclude_self: bool = False, encoder: Callable | None = None,
                 n_queries: int | None = None) -> DataFrame:
    """Mean metrics of all jobs, tagged with their ``params``; equal vectors are built once.

    Only query tables are asked, or ``n_queries`` of those that have vectors. Cells that none of the
    sparse methods can have in its sample are left out once for all of them.
    """
    gt = asked(gt, columns_meta)
    sizes = [with_defaults(job.method, job.embedding_params)["sample_size"] for job in jobs if job.method != "encoder"]
    sampled = cut(sample_front(cells, max(sizes))) if sizes else cells
    built: dict[str, DataFrame] = {}
    parts = []
    for job in jobs:
        key = job.method + param_hash(full_params(job.method, job.embedding_params, encoder))
        if key not in built:
            built[key] = cut(_vectors(cells if job.method == "encoder" else sampled, columns_meta, job, encoder))
        wanted = _sampled(gt, built[key], n_queries)
        ranked = _ranking(built[key], wanted, job, k, exclude_self)
        tags = [F.lit(text) for pair in job.params().items() for text in pair]
        parts.append(metrics_at_k(metrics_per_query(ranked, wanted, k)).withColumn(
            "params", F.create_map(*tags)))
    return reduce(DataFrame.unionByName, parts)


def run_jobs(spark: SparkSession, benchmark: str, cells: DataFrame, columns_meta: DataFrame,
             gt: DataFrame, jobs: list[Job], vectors: VectorStore, results: ResultStore,
             k: int = 10, exclude_self: bool = False, encoder: Callable | None = None,
             n_queries: int | None = None, run: str | None = None, workers: int = 1) -> str:
    """Runs jobs and stores a record of each, failed ones included; returns the name of the run.

    Vectors are taken from the store as far as it has them for this benchmark, these parameters, this
    encoder and the tables as they are, else built and stored; building is the offline time, searching and
    scoring the online time. A record that cannot be written is warned of and does not stop the others.

    A run that was stopped goes on if its name is given as ``run``: jobs with a record are left out unless
    they failed. Up to ``workers`` jobs run at once, each in a scheduler pool of its own; jobs with equal
    vectors wait for the one that builds them.
    """
    gt = asked(gt, columns_meta)
    finished = set() if run is None else results.finished(spark, run)
    run = run or uuid.uuid4().hex
    prints = cut(table_prints(cells, columns_meta))

    def start(job: Job) -> dict[str, Any]:
        # The names of a record's fields and the words for its status.
        return {
            "run": run, "benchmark": benchmark, "method": job.method, "k": k, "exclude_self": exclude_self,
            "embedding_params": {k_: str(v) for k_, v in job.embedding_params.items()},
            "eval_params": {k_: str(v) for k_, v in job.eval_params.items()},
            "status": "started", "error": None, "traceback": None, "offline": None,
            "online": None, "vector_path": None,
        }

    def work(job: Job) -> None:
        record = start(job)
        metrics = detail = None
        try:
            started = time.time()
            params = full_params(job.method, job.embedding_params, encoder)
            stored, n_built = refreshed_vectors(
                vectors, benchmark, job.method, job.embedding_params, cells, columns_meta, encoder, prints)
            record["offline"] = time.time() - started if n_built else 0.0
            record["vector_path"] = vectors.path(benchmark, job.method, params)
            record["status"] = "embeddings_generated" if n_built else "embeddings_loaded"
            if job.eval_params["agg"] == "None" and "threshold" not in job.eval_params:
                record["status"] = "evaluation_skipped"
                record["error"] = "matching needs a threshold"
            else:
                started = time.time()
                wanted = _sampled(gt, stored, n_queries)
                ranked = cut(_ranking(stored, wanted, job, k, exclude_self))
                if ranked.isEmpty():
                    record["status"] = "no_valid_queries"
                    record["error"] = "no query of the ground truth has a vector"
                else:
                    metrics = cut(metrics_at_k(metrics_per_query(ranked, wanted, k)))
                    detail = ranking_detail(ranked, wanted)
                    record["status"] = "completed"
                record["online"] = time.time() - started
        except Exception as error:  # one failed combination must not stop the others
            record["status"], record["error"] = "failed", str(error)
            record["traceback"] = traceback.format_exc()
        try:
            results.append(spark, record, metrics, detail)
        except Exception as error:
            warnings.warn(f"no record of {results.run_id(record)}: {error}", stacklevel=2)

    def work_in_pool(numbered: tuple[int, Job]) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{run}-{numbered[0]}")
        work(numbered[1])

    open_jobs = [job for job in jobs if results.run_id(start(job)) not in finished]
    if workers == 1:
        for job in open_jobs:
            work(job)
    else:
        with ThreadPool(workers) as threads:
            threads.map(inheritable_thread_target(spark)(work_in_pool), list(enumerate(open_jobs)), chunksize=1)
    return run
