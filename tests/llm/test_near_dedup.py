"""Near-duplicate classes against all pairs of a small corpus."""

import random

import numpy as np
import pytest

from tablekin.llm import near_dedup as nd
from tablekin.llm.components import components


def longest_common(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = row[:]
        for j, b in enumerate(y):
            row[j + 1] = before[j] + 1 if a == b else max(row[j], before[j + 1])
    return row[-1]


def similar(x, y):
    if x == y:
        return bool(x)
    hashes = nd.WordHashes()
    a, b = nd.labelled_kmers(x, hashes).tolist(), nd.labelled_kmers(y, hashes).tolist()
    common = longest_common(a, b)
    return bool(common) and 10 * common >= 8 * (len(a) + len(b) - common)


def all_pairs(docs):
    words = {key: nd.words_of(text) for key, text in docs}
    root = {key: key for key in words}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    for a in words:
        for b in words:
            if a < b and find(a) != find(b) and similar(words[a], words[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {key: find(key) for key in words}


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 4)))
    passage = [word() for _ in range(30)]
    made, key = [], 0
    for group in range(14):
        base = [word() for _ in range(draw.choice([3, 9, 60, 150]))]
        if group % 3 == 0:
            base = base + passage
        for _ in range(draw.choice([1, 2, 5])):
            copy = list(base)
            if draw.random() < .7:
                for _ in range(max(1, len(copy) // 100)):
                    at = draw.randrange(len(copy))
                    copy[at:at + 1] = draw.choice([[], [word()], [word(), copy[at]]])
            made.append((key, (", " if draw.random() < .2 else " ").join(copy).upper() if draw.random() < .2 else " ".join(copy)))
            key += 1
    return made + [(900, None), (901, ""), (902, " .,"), (903, "one two"), (904, "One  two!"), (905, "a b c d e " * 500)]


def test_equals_all_pairs(spark, docs):
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, node int, same string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in nd.report(frame).collect()}
    assert got == {key: (root, key == root) for key, root in all_pairs(docs).items()}
    kept = nd.drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {key for key, (_, own) in got.items() if own}


def test_join_path_equals_broadcast_path(spark, docs, monkeypatch):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    before = sorted(map(tuple, nd.report(frame).collect()))
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    monkeypatch.setattr(nd, "GROUP", 2)
    monkeypatch.setattr(nd, "COLUMNS", 16)
    assert sorted(map(tuple, nd.report(frame).collect())) == before


def test_alignment_equals_full_table():
    draw = np.random.default_rng(2)
    for _ in range(300):
        x = draw.permutation(40)[:draw.integers(5, 40)].astype(np.int32)
        y = np.array([v for v in x if draw.random() > .1] + list(draw.integers(50, 60, 1)), np.int32)
        if draw.random() < .4 and len(y) > 3:
            y[[1, 2]] = y[[2, 1]]
        y = y[np.sort(np.unique(y, return_index=True)[1])]
        common = longest_common(x.tolist(), y.tolist())
        assert nd.aligned(x, y) == (10 * common >= 8 * (len(x) + len(y) - common))


def test_repeated_rows_and_empty(spark):
    text = " ".join(f"word{i}" for i in range(30))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "else")], "doc_id long, text string")
    assert sum(r["kept"] for r in nd.report(frame).collect()) == 2
    assert nd.drop_near_copies(frame).count() == 2
    assert nd.report(frame.filter("doc_id > 9")).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i + 1, i) for i in range(100, 130)] + [(1, i) for i in range(2, 40)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = {r["node"]: r["root"] for r in components(frame).collect()}
    assert len(roots) == 31 + 39
    assert len({roots[i] for i in range(100, 131)}) == 1 and len({roots[i] for i in range(1, 40)}) == 1
    assert roots[1] != roots[100]
