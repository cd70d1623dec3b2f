import numpy as np
import pytest

from tablekin.operators.overlap import overlap_histogram, value_sets_by_type
from tablekin.operators.statistics import unit_interval_stats
from tablekin.plans.overlap_report import OverlapReport
from tests.helpers import gt_of, lake_of, rows

QUERY = {"id": [1, 2, 3], "city": ["New York", "Paris", "Paris"], "pop": [1.5, 2.0, 2.0]}
CANDIDATE = {"id": [2, 3, 4], "city": ["New Delhi"] * 3, "zip": ["2020-01-01", None, None],
             "note": [1.0, 2.5, 2.5]}


@pytest.fixture(scope="module")
def report(spark):
    cells, meta = lake_of(spark, {
        ("query", "q"): QUERY, ("lake", "c"): CANDIDATE, ("query", "only"): {"id": [None]},
        ("lake", "q"): {"other": ["z"]}})
    gt = gt_of(spark, {"q": ["q", "c", "only", "gone"], "absent": ["c"]})
    return OverlapReport(cells, meta, gt)


def test_resolution(report):
    assert rows(report.resolved, "query_table", "cand_table", "location") == [
        ("q", "c", "lake"), ("q", "only", "query")]


def test_columns(report):
    row = report.columns.filter("cand_table = 'c'").first()
    assert (row["query_count"], row["cand_count"], row["common"]) == (3, 4, 2)
    assert row["overlap_coefficient"] == pytest.approx(2 / 3)
    assert row["jaccard"] == pytest.approx(2 / 5)
    assert row["common_columns"] == ["city", "id"]


def test_values(report):
    row = report.values.filter("cand_table = 'c'").first()
    assert (row["query_count"], row["cand_count"], row["common"]) == (7, 8, 4)
    assert row["overlap_coefficient"] == pytest.approx(4 / 7)
    assert row["jaccard"] == pytest.approx(4 / 11)
    empty = report.values.filter("cand_table = 'only'").first()
    assert (empty["cand_count"], empty["overlap_coefficient"]) == (0, 0.0)


def test_types(report):
    got = {r["data_type"]: (r["query_count"], r["cand_count"], r["common"],
                            round(r["overlap_coefficient"], 6), round(r["jaccard"], 6))
           for r in report.values_by_type.filter("cand_table = 'c'").collect()}
    assert got == {"integer": (3, 3, 2, 0.666667, 0.5), "string": (3, 2, 1, 0.5, 0.25),
                   "float": (2, 2, 0, 0.0, 0.0), "other": (0, 1, 0, 0.0, 0.0)}


def test_summary(report):
    row = report.summary().first()
    assert (row["total_queries"], row["total_relationships"], row["avg_candidates"],
            row["found_queries"], row["self_pairs"], row["queries_as_candidates"]) == (
        1, 2, 2.0, 2, 1, True)


def test_uncastable_columns_give_words(spark):
    cells, meta = lake_of(spark, {
        ("query", "q"): {"c": ["1"] * 8 + [None, "Big x"]}, ("lake", "c"): {"c": ["x y"]}})
    report = OverlapReport(cells, meta, gt_of(spark, {"q": ["c"]}))
    sets = value_sets_by_type(report.value_sets).filter("side = 'query'")
    assert rows(sets, "data_type", "value_key") == [
        ("string", "s:1"), ("string", "s:big"), ("string", "s:x")]


@pytest.mark.parametrize(("common", "smaller", "expected"), [
    (0, 5, "0-10"), (1, 10, "10-20"), (29, 100, "20-30"), (3, 10, "30-40"), (99, 100, "90-100"),
    (1, 1, "90-100"), (0, 0, "0-10")])
def test_bins(spark, common, smaller, expected):
    pair = spark.createDataFrame([(common, smaller, smaller + 1)],
                                 "common long, query_count long, cand_count long")
    assert [tuple(r) for r in overlap_histogram(pair).collect()] == [(expected, 1, 100.0)]
    assert overlap_histogram(pair.limit(0)).count() == 10


def test_statistics(spark):
    frame = spark.createDataFrame([(v,) for v in (0.0, 0.25, 0.5, 1.0)], "v double")
    row = unit_interval_stats(frame, "v", []).first().asDict()
    expected = {"count": 4, "mean": 0.4375, "median": 0.375, "std": 0.369755, "min": 0.0,
                "max": 1.0, "q1": 0.1875, "q3": 0.625, "iqr": 0.4375, "p10": 0.075, "p90": 0.85}
    assert row == pytest.approx(expected, abs=1e-6)


def test_statistics_of_many_values(spark):
    rng = np.random.default_rng(3)
    # a third of the values is the same
    values = np.where(rng.random(3000) < 0.33, 1.0, rng.integers(0, 700, 3000) / 700)
    groups = rng.integers(0, 3, 3000)
    frame = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, values)],
                                  "g int, v double").repartition(7)
    for row in unit_interval_stats(frame, "v", ["g"]).collect():
        here = values[groups == row["g"]]
        assert row["std"] == pytest.approx(np.std(here))
        for name, q in {"median": 50, "q1": 25, "q3": 75, "p10": 10, "p90": 90}.items():
            assert row[name] == pytest.approx(np.percentile(here, q))


def test_written_report(report, tmp_path, spark):
    report.write(str(tmp_path), "b")
    summary = spark.read.json(f"{tmp_path}/b_overlap_summary").first()
    assert summary["total_relationships"] == 2 and summary["benchmark_name"] == "b"
    assert spark.read.json(f"{tmp_path}/b_overlap_detailed").count() == 2


def test_statistics_of_several_groupings(spark):
    rng = np.random.default_rng(4)
    data = [(f"q{rng.integers(5)}", f"m{rng.integers(2)}", float(rng.integers(0, 12) / 12)) for _ in range(400)]
    frame = spark.createDataFrame([*data, (None, "m0", 0.5)], "q string, m string, v double")
    got = unit_interval_stats(frame, "v", ["q", "m"], [["q", "m"], ["m"]]).collect()
    assert len(got) == len({row[:2] for row in data}) + 1 + 2
    for row in got:
        # a missing key is a group of its own, not the group of all
        here = [v for q, m, v in [*data, (None, "m0", 0.5)]
                if m == row["m"] and (row["grouping_id"] == 2 or q == row["q"])]
        assert row["count"] == len(here)
        assert row["median"] == pytest.approx(np.median(here))
        assert row["p90"] == pytest.approx(np.percentile(here, 90))


def test_one_expansion(report):
    from tablekin.operators import overlap
    plan = overlap.grouped_stats(overlap.coefficients(report.columns, report.values, report.values_by_type))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in text
    per_query = {(r["query_table"], r["measure"]): r["count"] for r in report.by_query().collect()}
    assert {r["measure"]: r["count"] for r in report.stats().collect()} == {
        measure: n for (_, measure), n in per_query.items()}
