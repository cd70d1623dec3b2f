"""Context-tree weighting against sums worked out one by one, and on texts it has not seen."""

import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tablekin.llm import ctw


def words(text):
    return (text or "").encode().lower().split()


def expected_base(docs):
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in docs}
    counts = Counter()
    for key, text in docs:
        if not held[key]:
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for key, text in docs:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out[key] = (held[key], len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 7))
    return out


@pytest.fixture(scope="module")
def docs():
    draw = np.random.default_rng(4)
    said = ["the cat sat\ton the mat", "The dog  sat on\x0bthe log", "a stitch in time", "été là-bas", None, "", "x" * 5000]
    made = [(i, " ".join(str(draw.choice(["red", "Green", "blue", "été", f"w{i}"])) for _ in range(draw.integers(0, 40)))) for i in range(60)]
    return made + [(100 + i, text) for i, text in enumerate(said)]


@pytest.mark.parametrize("bound", [0, 4, 1 << 18])
def test_base_equals_plain_counting(spark, docs, bound):
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, token string, n int")
    got = {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 7))
           for r in ctw.report(frame.repartition(3), bound).collect()}
    assert got == expected_base(docs)


def kt(zeros, ones):
    p = Fraction(1)
    for i in range(zeros):
        p *= Fraction(2 * i + 1, 2 * (i + 1))
    for i in range(ones):
        p *= Fraction(2 * i + 1, 2 * (zeros + i + 1))
    return p


def weighted_log10(training, text):
    """The mixture over context depths in exact fractions."""
    counts = {}
    for said in training:
        data = b"\0\0" + said + b"\xff"
        for i in range(2, len(data)):
            for depth in range(3):
                for bit in range(8):
                    node = (data[i - depth:i], bit, data[i] >> (8 - bit))
                    zeros, ones = counts.get(node, (0, 0))
                    one = data[i] >> (7 - bit) & 1
                    counts[node] = (zeros + 1 - one, ones + one)
    below = {}
    for (context, bit, prefix) in counts:
        if context:
            below.setdefault((context[1:], bit, prefix), []).append((context, bit, prefix))

    def weigh(node):
        own = kt(*counts[node])
        if len(node[0]) == 2:
            return own
        rest = Fraction(1)
        for child in below.get(node, []):
            rest *= weigh(child)
        return (own + rest) / 2

    def one(data, i, bit, depth=0):
        node = (data[i - depth:i], bit, data[i] >> (8 - bit))
        zeros, ones = counts.get(node, (0, 0))
        own = Fraction(2 * ones + 1, 2 * (zeros + ones + 1))
        child = (data[i - depth - 1:i], bit, data[i] >> (8 - bit))
        if depth == 2 or child not in counts:
            return own
        stay = kt(zeros, ones) / 2 / weigh(node)
        return stay * own + (1 - stay) * one(data, i, bit, depth + 1)

    data, total = b"\0\0" + text + b"\xff", 0.0
    for i in range(2, len(data)):
        for bit in range(8):
            p = one(data, i, bit)
            total += math.log10(p if data[i] >> (7 - bit) & 1 else 1 - p)
    return total


def test_scores_equal_exact_fractions(spark):
    training = [b"abab", b"abcab", b"", b"ba\xc3\xa9"]
    frame = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(training)], "doc_id long, text string")
    model = ctw.fit(frame)
    for text in [b"ab", b"", b"zq", b"abcabc", b"\xc3\xa9b"]:
        assert model.scores([text])[0] == pytest.approx(weighted_log10(training, text), abs=1e-4)


def test_small_chunks_make_no_difference(spark, docs, monkeypatch):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    texts = [(t or "").encode() for _, t in docs]
    model = ctw.fit(frame)
    whole = model.scores(texts)
    monkeypatch.setattr(ctw, "CHUNK", 7)
    assert np.allclose(model.scores(texts), whole)
    assert np.allclose(ctw.fit(frame).scores(texts), whole)


def test_held_out_texts_code_shorter_than_by_single_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["text"], r["score"]) for r in ctw.report(docs).filter("held_out").join(docs, "doc_id").collect()]
    counts = Counter(b"".join(r["text"].encode() for r in docs.collect()))
    total = sum(counts.values())
    single = sum(math.log10(counts[b] / total) for text, _ in rows for b in text.encode())
    assert sum(score for _, score in rows) > 0.8 * single


def test_no_training_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    frame = spark.createDataFrame([(held, "ab")], "doc_id long, text string")
    row = ctw.report(frame).first()
    assert (row["train_tokens"], row["base_score"], row["n_known"]) == (0, 0.0, 0)
    assert row["score"] == pytest.approx(-3 * math.log10(256), abs=1e-4)
    assert row["bits_per_byte"] == pytest.approx(-row["score"] * math.log2(10) / 2)
    assert ctw.report(spark.createDataFrame([(held, None)], "doc_id long, text string")).first()["bits_per_byte"] is None
    assert ctw.report(frame.filter("doc_id < 0")).collect() == []
