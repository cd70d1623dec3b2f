"""Whitening against numpy's own decomposition, exact counts, and awkward rows."""

import math

import numpy as np
import pytest

from tablekin.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string, _row string"


def frame(spark, rows, schema="vec_id long, embedding array<double>"):
    return spark.createDataFrame(rows, schema)


def plain(rows, k=4):
    """The same from all rows at once, in whole numbers where they are asked for."""
    x = [(vec_id, [math.floor(256 * c) for c in vector]) for vec_id, vector in rows]
    fit = np.array(sorted({tuple(vector) for _, vector in x}), float)
    n, total = len(fit), [sum(int(v) for v in column) for column in fit.T]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for vec_id, vector in x:
        deviation = sum((n * c - s) ** 2 for c, s in zip(vector, total, strict=True))
        white = (np.array(vector) - fit.mean(axis=0)) @ vectors / np.sqrt(values)
        for j in range(len(values)):
            out[vec_id, j + 1] = (n, deviation, white[j], values[j] / np.trace(centred.T @ centred / n))
    return out


def test_report_equals_a_plain_decomposition(spark):
    random = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in random.normal(size=9) * np.arange(1, 10)]) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # copies count once in the fit
    got = whitening.report(frame(spark, rows).repartition(5)).collect()
    expected = plain(rows)
    assert len(got) == len(expected) == 480
    signs = {r["component"]: np.sign(r["whitened"]) * np.sign(expected[0, r["component"]][2]) for r in got if r["vec_id"] == 0}
    for r in got:
        n, deviation, white, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["n"] == 80
        assert abs(r["whitened"] * signs[r["component"]] - white) < 1e-9
        assert abs(r["explained"] / explained - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_awkward_rows(spark):
    good = [(1, [0.5, -0.25, 0.0]), (2, [0.0, 1.0, 0.1]), (2, [0.0, 1.0, 0.1]), (None, [-0.0, 0.3, 0.9]), (5, [2.0, 0.0, 0.5])]
    bad = [(6, None), (7, []), (8, [None, 1.0, 1.0]), (9, [float("nan"), 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0]), (11, [1.0]),
           (12, [1e300, 0.0, 0.0])]
    rows = [(vec_id, vector, 7, "x", None) for vec_id, vector in good + bad]
    got = whitening.report(frame(spark, rows, SCHEMA)).collect()
    ids = [r["vec_id"] for r in got if r["component"] == 1]
    assert sorted(ids, key=str) == [1, 2, 2, 5, None] and {r["n"] for r in got} == {4}
    assert {r["component"] for r in got} == {1, 2, 3}
    whole = whitening.taken(frame(spark, rows, SCHEMA))
    kept = whitening.whiten(whole, whitening.fit(whole, 2)).select("_row.*", "whitened").collect()
    assert {r["component"] for r in kept} == {"x"} and all(len(r["whitened"]) == 2 for r in kept)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)]])
def test_no_direction_no_rows(spark, rows):
    got = whitening.report(frame(spark, rows))
    assert got.collect() == [] and len(got.columns) == 7


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**50 + 2**20 * i), float(i * i)]) for i in range(5)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.report(frame(spark, rows)).collect()}
    assert got == {vec_id: (d if (d := plain(rows)[vec_id, 1][1]) < 2**63 else None) for vec_id, _ in rows}


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0], [9, 4, 4 - 1e-9, 4 - 2e-9, 1, 1], [3, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6]])
def test_eigenpairs_of_close_and_equal_values(values):
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))
    matrix = turn @ np.diag(np.array(values, float)) @ turn.T
    found, vectors = eigen.leading_pairs((matrix + matrix.T) / 2, 4)
    assert np.allclose(found, sorted(values, reverse=True)[:4], atol=1e-13)
    assert np.abs(matrix @ vectors.T - vectors.T * found).max() < 1e-13
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-13


def test_counts_of_eigenvalues_below():
    diagonal, off = np.array([2.0, 0.0, 1.0, 3.0]), np.array([1.0, 0.0, 0.5])
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-2, 5, 29) + 1e-7
    assert eigen.below(diagonal, off, at).tolist() == [(values < x).sum() for x in at]
