"""The toxicity network: gradients, windows, remembered inputs and held-out accuracy."""

import numpy as np
import pytest

from tablekin.llm import toxicity as tx
from tablekin.llm.near_dedup import words_of

WORDS = [b"alpha", b"beta", "été".encode(), b"x", b"gamma7"]


def plain_logit(network, words):
    """One window, word by word, in double precision."""
    p = {name: value.astype(float) for name, value in network.p.items()}
    x = np.stack([network.projected([word])[0].astype(float) for word in words])
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    h = tx.HIDDEN

    def read(rows, weights):
        state, out = np.zeros(h), []
        for row in rows:
            a = state @ weights
            z, r = sigmoid(row[:h] + a[:h]), sigmoid(row[h:2 * h] + a[h:2 * h])
            n = np.tanh(row[2 * h:] + r * a[2 * h:])
            state = (1 - z) * n + z * state
            out.append(state)
        return out

    states = np.concatenate([read(x[:, :3 * h], p["ahead"]), read(x[::-1, 3 * h:], p["back"])[::-1]], 1)
    worth = np.tanh(states @ p["look"] + p["look_bias"]) @ p["weigh"]
    share = np.exp(worth - worth.max())
    return float((share / share.sum()) @ states @ p["out"] + p["out_bias"][0])


def test_gradients_are_those_of_the_loss():
    network = tx.Network(1)
    network.p = {name: value.astype(np.float64) for name, value in network.p.items()}
    at = np.array([[0, 1], [2, 3], [4, 0], [1, 0]])
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    truth, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])
    loss = lambda: network.gradients(WORDS, at, mask, truth, weight)[0]
    _, g = network.gradients(WORDS, at, mask, truth, weight)
    for name in g:
        gradient = g[name]
        if isinstance(gradient, tuple):
            row = int(gradient[0][0])
            gradient, place = gradient[1][gradient[0] == row].sum(0), (row, 2)
            expected = gradient[2]
        else:
            place = tuple(size // 2 for size in gradient.shape)
            expected = gradient[place]
        value, step = network.p[name], 1e-3
        old = value[place]
        value[place] = old + step
        up = loss()
        value[place] = old - step
        down = loss()
        value[place] = old
        assert (up - down) / (2 * step) == pytest.approx(float(expected), abs=2e-5), name


def test_windows_cover_all_words():
    for n in [0, 1, 23, 24, 25, 36, 37, 100]:
        starts = tx.windows(n).tolist()
        seen = {w for a in starts for w in range(a, min(a + tx.WINDOW, n))}
        assert seen == set(range(n)) and all(a + tx.WINDOW <= max(n, tx.WINDOW) for a in starts)


def test_scores_equal_every_window_on_its_own(monkeypatch):
    network, draw = tx.Network(2), np.random.default_rng(0)
    texts = [[WORDS[i] + str(j % 7).encode() for j, i in enumerate(draw.integers(0, 5, n))] for n in (1, 5, 24, 30, 70)] + [[]]
    monkeypatch.setattr(tx, "KNOWN_WORDS", 12)
    monkeypatch.setattr(tx, "GROUP", 3)
    got = tx.Scorer(network).highest(texts)
    for words, value in zip(texts, got):
        if words:
            assert value == pytest.approx(max(plain_logit(network, words[a:a + tx.WINDOW]) for a in tx.windows(len(words))), abs=1e-4)
        else:
            assert np.isnan(value)


def test_character_runs_of_words():
    rows, edges = tx.run_hashes([b"abc", b"", b"abcd"])
    assert edges.tolist() == [0, 3, 3, 7] or edges.tolist() == [0, 3, 4, 8] or len(rows) == edges[-1]
    again, _ = tx.run_hashes([b"abcd"])
    assert rows[edges[2]:].tolist() == again.tolist()


@pytest.fixture(scope="module")
def judged(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return tx.report(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(judged):
    held = judged[judged.held_out]
    right = held.predicted == held.toxic
    assert len(held) > 500
    assert right[held.toxic == 1].mean() > 0.9 and right[held.toxic == 0].mean() > 0.97


def test_nulls_ties_and_no_labels(spark):
    rows = [(i, "good plain words here", 1) for i in range(20)] + [(100 + i, "you idiot fool", 2) for i in range(20)]
    rows += [(None, "you idiot fool", 3), (7, None, 4), (7, "", 5), (300, "idiot " * 3000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in range(140)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = tx.report(docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r["predicted"] == (r["doc_id"] is None or r["doc_id"] >= 100) for r in out)
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 22
    assert {r["score"] for r in tx.report(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert tx.report(docs.filter("score > 9"), labels).collect() == []
    assert words_of(None) == []
