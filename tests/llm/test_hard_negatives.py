"""Hard negatives against a loop over all rows, Strassen products, and awkward rows."""

import math

import numpy as np
import pytest

from tablekin.llm import hard_negatives
from tablekin.llm.strassen import inner_products

SCHEMA = "vec_id long, label int, embedding array<double>, score string, x int"
ANCHORS = "vec_id % 100 = 0"


def plain(rows, k=5):
    usable = sorted({(i, label, tuple(math.floor(256 * c) for c in v)) for i, label, v, *_ in rows
                     if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    usable = [r for r in usable if max(map(abs, r[2]), default=0) < 2**40]
    out = []
    for anchor in (r for r in usable if r[0] % 100 == 0):
        scored = [(-sum(a * b for a, b in zip(anchor[2], r[2], strict=False)), r[0], r[1] == anchor[1]) for r in usable if r != anchor]
        for place, (top, positive, _) in enumerate(sorted(s for s in scored if s[2])[:k], 1):
            window = sorted(s for s in scored if not s[2] and 80 * -top <= 100 * -s[0] <= 100 * -top)[:k]
            out += [(anchor[0], positive, rank, i, -top, -score, place) for rank, (score, i, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(frame, ANCHORS, **more).collect())


def cloud(n, seed=0, step=5):
    random = np.random.default_rng(seed)
    centre = random.normal(size=6)
    return [(i * step, int(random.integers(3)), [float(c) for c in centre + 0.2 * random.normal(size=6)], "s", 1) for i in range(n)]


@pytest.mark.parametrize("block", [16_384, 3])
def test_equals_a_plain_search(spark, block):
    rows = cloud(300)
    expected = plain(rows)
    assert len(expected) > 200 and mined(spark, rows, block_anchors=block) == expected


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CANDIDATE_TILE", 7)
    rows = [(i, i % 2, [1.0, float(i % 3 == 0)], "s", 1) for i in range(0, 400, 4)]
    rows += [(i + 1, 1, [1.0, 1.0], "s", 1) for i in range(0, 400, 4)]
    rows += [(100, 0, [1.0, 0.0], "s", 1)] * 3 + [(100, 0, [0.0, 2.0], "s", 1), (100, 1, [1.0, 0.0], "t", 2)]
    expected = plain(rows)
    assert len(expected) > 30 and mined(spark, rows) == expected


def test_awkward_rows(spark):
    rows = cloud(60) + [(100, None, [1.0] * 6, "s", 1), (200, 1, None, "s", 1), (300, 1, [None] * 6, "s", 1), (None, 1, [1.0] * 6, "s", 1),
                        (400, 1, [float("nan")] * 6, "s", 1), (500, 1, [float("inf")], "s", 1), (600, 1, [], "s", 1), (700, 2, [0.4], "s", 1),
                        (-100, 0, [3.0, -1.0], None, None), (800, 1, [1e200], "s", 1)]
    expected = plain(rows)
    assert expected and mined(spark, rows) == expected
    assert mined(spark, []) == [] and mined(spark, [(7, 1, [1.0], "s", 1)]) == []
    assert mined(spark, [(100, 1, [1.0], "s", 1)]) == []


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 90, 5), (70, 90, 64), (130, 257, 65), (40, 40, 0), (0, 9, 4)])
def test_strassen_products_are_exact(shape):
    m, n, d = shape
    random = np.random.default_rng(m)
    a, c = random.integers(-2**26, 2**26, (m, d)), random.integers(-2**26, 2**26, (n, d))
    assert (inner_products(a, c) == a.astype(object) @ c.T.astype(object)).all()


def test_windows_of_large_scores():
    tops = np.array([0, 1, 4, 5, 99, 100, 101, 2**62 - 1, -5, -100])
    short = 20
    floors = tops - (tops // 100 * short + tops % 100 * short // 100)
    assert floors.tolist() == [-(-80 * int(top) // 100) for top in tops]
