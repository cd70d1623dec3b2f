"""Contexts of up to six bytes against exact fractions, with any bound of the broadcast table."""

import math
import zlib
from fractions import Fraction
from functools import cache

import pytest

from tablekin.llm import ctw


@cache
def kt(zeros, ones):
    p = Fraction(1)
    for i in range(zeros):
        p *= Fraction(2 * i + 1, 2 * (i + 1))
    for i in range(ones):
        p *= Fraction(2 * i + 1, 2 * (zeros + i + 1))
    return p


def expected(training, text, depth=6):
    start, counts, below = b"\0" * depth, {}, {}
    for said in training:
        data = start + said + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for bit in range(8):
                    node = (data[i - d:i], bit, data[i] >> (8 - bit))
                    zeros, ones = counts.get(node, (0, 0))
                    one = data[i] >> (7 - bit) & 1
                    counts[node] = (zeros + 1 - one, ones + one)
    for context, bit, prefix in counts:
        if context:
            below.setdefault((context[1:], bit, prefix), []).append((context, bit, prefix))

    @cache
    def weigh(node):
        own = kt(*counts[node])
        if len(node[0]) == depth:
            return own
        return (own + math.prod((weigh(child) for child in below.get(node, [])), start=Fraction(1))) / 2

    def one(data, i, bit, d=0):
        node = (data[i - d:i], bit, data[i] >> (8 - bit))
        zeros, ones = counts.get(node, (0, 0))
        own = Fraction(2 * ones + 1, 2 * (zeros + ones + 1))
        if d == depth or (data[i - d - 1:i], bit, data[i] >> (8 - bit)) not in counts:
            return own
        stay = kt(zeros, ones) / 2 / weigh(node)
        return stay * own + (1 - stay) * one(data, i, bit, d + 1)

    data = start + text + b"\xff"
    p = [(one(data, i, bit), data[i] >> (7 - bit) & 1) for i in range(depth, len(data)) for bit in range(8)]
    return sum(math.log10(q if is_one else 1 - q) for q, is_one in p)


def held(key):
    return zlib.crc32(str(key).encode()) % 7 == 2


DOCS = list(enumerate(["the cat sat on the mat", "the cat sat on the hat", "", "été là", "日本語の文", "日本語", "zq\x00\x00\x00", "a" * 40] * 3
                      + ["the cat sat on the mat and the bat", "日本の文", "qqq"]))


@pytest.mark.parametrize("bound", [0, 60, 1 << 21])
def test_six_bytes_of_context_equal_exact_fractions(spark, monkeypatch, bound):
    monkeypatch.setattr(ctw, "SUBTREE_ROWS", 20)
    monkeypatch.setattr(ctw, "COUNTED_RUNS", 50)
    monkeypatch.setattr(ctw, "CHUNK", 30)
    training = [text.encode() for key, text in DOCS if not held(key)]
    got = {r["doc_id"]: r["score"] for r in ctw.report(
        spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), run_bound=bound).collect()}
    assert any(held(key) for key, _ in DOCS) and got.keys() == dict(DOCS).keys()
    for key, text in DOCS:
        assert got[key] == pytest.approx(expected(training, text.encode()), abs=1e-4)


def test_words_before_decide(spark):
    """What follows depends on more than two bytes: a tree of two cannot tell them apart."""
    kept = [key for key in range(400) if not held(key)]
    texts = ["red means stop" if i % 2 else "bad means slow" for i in range(len(kept))]
    asked = {1000: "red means stop", 1001: "red means slop"}
    frame = spark.createDataFrame([*zip(kept, texts), *asked.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.report(frame).collect()}
    assert got[1000] > got[1001] + 1
