"""Records read back do not depend on what other records hold."""

import pytest

from tablekin.sources.result_store import ResultStore

RECORD = {
    "run": "r", "benchmark": "b", "method": "hash", "k": 2, "exclude_self": False, "embedding_params": {"n": "64"},
    "eval_params": {"agg": "max"}, "status": "completed", "error": None, "traceback": None, "offline": 1.0, "online": None,
    "vector_path": None}


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_records_stay_as_they_were_when_others_follow(spark, tmp_path, fmt):
    store = ResultStore(str(tmp_path), fmt)
    assert store.finished(spark, "r") == set()
    store.append(spark, RECORD)
    first = store.runs(spark).first()
    assert first["error"] is None and first["embedding_params"] == {"n": "64"}
    store.append(spark, RECORD | {
        "method": "word", "status": "failed", "error": "no such pooling", "embedding_params": {"size": "5"}, "online": 2.0})
    runs = store.runs(spark).collect()
    assert len(runs) == 2 and first in runs and len(store.finished(spark, "r")) == 1
