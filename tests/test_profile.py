import pytest

from tablekin.plans.profile_report import ProfileReport
from tests.helpers import lake_of


@pytest.fixture(scope="module")
def report(spark):
    cells, meta = lake_of(spark, {
        ("lake", "a"): {"x": [1, 2], "y": ["u", None]}, ("lake", "b"): {"x": [1, 2, 3]},
        ("lake", "q"): {f"c{i}": [1] * 9 for i in range(9)},
        ("query", "q"): {"x": ["p"], "z": ["1.5"], "w": ["2"]}})
    return ProfileReport(cells, meta)


def test_lake_side(report):
    row = report.per_side().filter("side = 'lake'").first()
    assert (row["files"], row["total_rows"], row["total_columns"], row["total_cells"]) == (2, 5, 3, 7)
    assert (row["missing"], row["missing_pct"]) == (1, 14.29)
    assert (row["avg_rows"], row["avg_columns"]) == (2, 2)
    assert row["unique_columns"] == 2
    assert {k: tuple(v) for k, v in row["column_stats"].items()} == {
        "integer": (2, 66.67), "string": (1, 33.33)}


def test_combined(report):
    row = report.combined().first()
    assert (row["files"], row["total_rows"], row["total_columns"], row["total_cells"]) == (3, 6, 6, 10)
    assert (row["missing"], row["missing_pct"], row["unique_columns"]) == (1, 10.0, 4)


def test_written(report, tmp_path, spark):
    report.write(str(tmp_path), "b")
    row = spark.read.json(f"{tmp_path}/b_overall").first()
    assert row["sides"]["lake"]["files"] == 2 and row["combined"]["files"] == 3
