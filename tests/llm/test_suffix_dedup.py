"""Removal of repeats against a dictionary of all 100-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from tablekin.llm import suffix_dedup as sd


def brute(docs):
    first, out = {}, []
    texts = [(key, (text or "").encode()) for key, text in docs]
    for key, text in texts:
        for p in range(len(text) - 99):
            first.setdefault(text[p:p + 100], (key, p))
    for key, text in texts:
        gone = np.zeros(len(text) + 1, bool)
        for p in range(len(text) - 99):
            if first[text[p:p + 100]] != (key, p):
                gone[p:p + 100] = True
        gone = gone[:len(text)]
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((key, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcdefgh é") for _ in range(n))
    shared = [text(draw.choice([50, 99, 100, 101, 150, 300, 1000])) for _ in range(40)]
    made = []
    for key in range(200):
        parts = [draw.choice(shared) if draw.random() < .5 else text(draw.choice([0, 5, 60, 120]))
                 for _ in range(draw.randint(0, 5))]
        said = "".join(parts)
        if draw.random() < .3 and len(said) > 10:
            at = draw.randrange(len(said))
            said = said[:at] + "#" + said[at + 1:]
        made.append((key, said))
    return made + [(200, None), (201, "a" * 500), (202, "a" * 700), (203, "ab" * 300), (204, ""), (205, "ab" * 400)]


@pytest.mark.parametrize(("buckets", "split"), [(4_000_000, 20_000), (4_000_000, 3), (0, 3)])
def test_all_paths_equal_brute_force(spark, docs, monkeypatch, buckets, split):
    monkeypatch.setattr(sd, "BROADCAST_BUCKETS", buckets)
    monkeypatch.setattr(sd, "SPLIT_BUCKET", split)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, sd.report(frame).collect())) == brute(docs)


def test_texts_longer_than_a_chunk(spark, docs, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 70)
    frame = spark.createDataFrame(docs[:60], "doc_id long, text string").coalesce(1)
    data, offsets = sd.text_buffer(__import__("pyarrow").array([text for _, text in docs[:60]]))
    small = sd.find_anchors(data, offsets)
    monkeypatch.undo()
    for a, b in zip(small, sd.find_anchors(data, offsets)):
        assert (a == b).all()
    assert sorted(map(tuple, sd.report(frame).collect())) == brute(docs[:60])


def test_repeated_ids_clashing_columns_and_empty(spark):
    line = "x" * 60 + "y" * 60
    frame = spark.createDataFrame([(1, line, 0), (1, line, 1), (None, line, 2)], "doc_id long, text string, span int")
    rows = sorted(((r["doc_id"], r["n_removed"]) for r in sd.report(frame).collect()), key=str)
    assert rows == [(1, 120), (1, 120), (None, 0)]
    assert sd.report(frame.filter("span > 5")).collect() == []
    assert {bytes(r["kept"]) for r in sd.remove_repeats(frame).collect()} == {b"", line.encode()}
