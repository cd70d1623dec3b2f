"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word goes in as a vector of its own and as the scaled sum of vectors of its character runs (four
characters, word ends marked), so that unseen words with a known stem are told. Windows of 24 words, 12
apart, are read in both directions; attention pools the states of a window, and a document's
score is that of its highest window, fitted to probabilities by a logistic curve.

Training takes a bounded sample of labelled documents outside the held-out fold, half of them toxic
where there are as many. Which window of a toxic document is to blame is not labelled: the first windows are those
with the largest log odds of words and runs, later ones those the network scores highest.

Words: A-Z in lower case, runs of characters outside ASCII punctuation, blanks and control characters.
Texts without words score 0, as do all texts if no labels of both kinds are there. A document with several labels
is toxic if one says so; null labels and ids are not learned from. Repeated rows are scored one by one;
other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import KEY, by_value, id_remainder, keyed_whole, opened, released, shipped, small_batches, without
from tablekin.llm.near_dedup import words_of

shipped(__name__)

FOLDS, HELD_OUT = 5, 0
SAMPLE_ROWS = 6_000  # labelled documents learned from, at most
SAMPLE_CHARS = 50_000  # longer documents are not learned from
WINDOW, STEP = 24, 12
HIDDEN, WORD_SIZE, RUN_SIZE, ATTENTION = 8, 8, 8, 8
WORD_ROWS, RUN_ROWS = 1 << 15, 1 << 16
RUN = 4
KNOWN_WORDS = 200_000  # words whose inputs a task remembers
ROUNDS, EPOCHS, BATCH, RATE = 3, 3, 128, 0.05
RARE = 4  # log odds of what is seen in so many documents are halved
CLEAN_WINDOWS = 3  # windows of clean documents chosen at random, per document
GROUP = 2_048  # windows scored at once
GROUP_WORDS = 200_000  # words scored at once


def run_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character runs of all words in one array, and where those of each word start."""
    data = np.frombuffer(b"".join([b"\x01" + word + b"\x02\x02" for word in words]), np.uint8).astype(np.uint64)
    sizes = np.array([len(word) + 3 for word in words])
    starts = np.append(0, np.cumsum(sizes))
    code = data[:-3] | (data[1:-2] << np.uint64(8)) | (data[2:-1] << np.uint64(16)) | (data[3:] << np.uint64(24))
    code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    keep = np.ones(len(data), bool)
    for back in (1, 2, 3):
        keep[starts[1:] - back] = False
    edges = np.append(0, np.cumsum(np.maximum(sizes - 3, 0)))
    return code[keep[:-3]].astype(np.int64), edges


def word_row(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word) % WORD_ROWS


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * a) + 0.5


class Network:
    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        some = lambda *size: (draw.normal(size=size) * 0.3).astype(np.float32)
        size = WORD_SIZE + RUN_SIZE
        self.p = {
            "words": some(WORD_ROWS, WORD_SIZE) * 0.3, "runs": some(RUN_ROWS, RUN_SIZE) * 0.3,
            "inputs": some(size, 6 * HIDDEN), "input_bias": np.zeros(6 * HIDDEN, np.float32),
            "ahead": some(HIDDEN, 3 * HIDDEN), "back": some(HIDDEN, 3 * HIDDEN),
            "look": some(2 * HIDDEN, ATTENTION), "look_bias": np.zeros(ATTENTION, np.float32), "weigh": some(ATTENTION),
            "out": some(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, words: list[bytes]):
        """Input vectors of words, and what their gradients need."""
        own = np.fromiter(map(word_row, words), np.int64, len(words))
        runs, edges = run_hashes(words)
        share = 1 / np.sqrt(np.diff(edges)).astype(np.float32)
        summed = np.add.reduceat(self.p["runs"][runs], edges[:-1], axis=0) * share[:, None]
        return np.concatenate([self.p["words"][own], summed], 1), (own, runs, edges, share)

    def projected(self, words: list[bytes]) -> np.ndarray:
        return self.vectors(words)[0] @ self.p["inputs"] + self.p["input_bias"]

    def _read(self, x: np.ndarray, mask: np.ndarray, weights: np.ndarray, backwards: bool, keep: list | None):
        """States [T, B, H] of one direction over projected inputs [T, B, 3H]."""
        steps = len(x)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((steps, *h.shape), np.float32)
        for t in (range(steps - 1, -1, -1) if backwards else range(steps)):
            a = h @ weights
            gates = _sigmoid(x[t, :, :2 * HIDDEN] + a[:, :2 * HIDDEN])
            z, r, q = gates[:, :HIDDEN], gates[:, HIDDEN:], a[:, 2 * HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN:] + r * q)
            new = n + z * (h - n)
            new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, q, n))
            out[t] = h = new
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One number per window from projected inputs [T, B, 6H] and the mask [T, B] of real words."""
        p = self.p
        steps = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._read(x[..., :3 * HIDDEN], mask, p["ahead"], False, steps[0]),
                            self._read(x[..., 3 * HIDDEN:], mask, p["back"], True, steps[1])], 2)
        look = np.tanh(h @ p["look"] + p["look_bias"])
        worth = np.where(mask, look @ p["weigh"], -1e9)
        share = np.exp(worth - worth.max(0))
        share /= share.sum(0)
        pooled = (share[..., None] * h).sum(0)
        if keep is not None:
            keep.update(h=h, look=look, share=share, pooled=pooled, steps=steps, mask=mask)
        return pooled @ p["out"] + p["out_bias"][0]

    def gradients(self, words: list[bytes], at: np.ndarray, mask: np.ndarray, truth: np.ndarray, weight: np.ndarray,
                  told: np.ndarray | None = None):
        """Loss and gradients of a batch; ``at`` [T, B] are places in ``words``, ``told`` says which words'
        own vectors are used."""
        p, keep = self.p, {}
        vectors, (own, runs, edges, share) = self.vectors(words)
        told = np.ones(len(words), bool) if told is None else told
        vectors[~told, :WORD_SIZE] = 0
        x = vectors @ p["inputs"] + p["input_bias"]
        logit = self.logits(x[at], mask, keep)
        miss = (weight * (_sigmoid(logit) - truth) / len(truth)).astype(np.float32)
        loss = float((weight * (np.logaddexp(0, logit) - truth * logit)).mean())
        g = {"out": keep["pooled"].T @ miss, "out_bias": miss.sum(keepdims=True)}
        pooled = miss[:, None] * p["out"]
        h, look, part = keep["h"], keep["look"], keep["share"]
        dh = part[..., None] * pooled
        d_part = (h * pooled).sum(2)
        d_worth = part * (d_part - (part * d_part).sum(0))
        g["weigh"] = np.einsum("tba,tb->a", look, d_worth)
        d_look = d_worth[..., None] * p["weigh"] * (1 - look * look)
        g["look"], g["look_bias"] = np.einsum("tbh,tba->ha", h, d_look), d_look.sum((0, 1))
        dh += d_look @ p["look"].T
        dx = np.zeros((*at.shape, 6 * HIDDEN), np.float32)
        for name, steps, low in (("ahead", keep["steps"][0], 0), ("back", keep["steps"][1], 1)):
            weights, g[name] = p[name], np.zeros_like(p[name])
            d_next = np.zeros((at.shape[1], HIDDEN), np.float32)
            mine = dh[..., low * HIDDEN:(low + 1) * HIDDEN]
            for t, before, z, r, q, n in reversed(steps):
                d = mine[t] + d_next
                real = mask[t][:, None]
                d_new = np.where(real, d, 0)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (before - n) * z * (1 - z)
                d_r = d_n * q * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_n * r], 1)
                dx[t, :, low * 3 * HIDDEN:(low + 1) * 3 * HIDDEN] = np.concatenate([d_z, d_r, d_n], 1)
                g[name] += before.T @ d_a
                d_next = np.where(real, 0, d) + d_new * z + d_a @ weights.T
        d_word = np.zeros_like(x)
        np.add.at(d_word, at.ravel(), dx.reshape(-1, 6 * HIDDEN))
        g["inputs"], g["input_bias"] = vectors.T @ d_word, d_word.sum(0)
        d_vector = d_word @ p["inputs"].T
        g["words"] = (own[told], d_vector[told, :WORD_SIZE])
        g["runs"] = (runs, np.repeat(d_vector[:, WORD_SIZE:] * share[:, None], np.diff(edges), axis=0))
        return loss, g


def windows(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words; the last one reaches its end."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + 1, STEP)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


class Scorer:
    """Highest window logit of texts; inputs of words are remembered."""

    def __init__(self, network: Network):
        self.network = network
        self.known: dict[bytes, int] = {}
        self.inputs = np.zeros((1, 6 * HIDDEN), np.float32)
        self.used = 1  # row 0 is for places without a word

    def _places(self, texts: list[list[bytes]]) -> np.ndarray:
        missing = list({word for words in texts for word in words if word not in self.known})
        if self.used + len(missing) > KNOWN_WORDS and self.used > 1:
            self.known, self.used = {}, 1
            missing = list({word for words in texts for word in words})
        if missing:
            made = self.network.projected(missing)
            need = self.used + len(missing)
            if need > len(self.inputs):
                grown = np.zeros((max(need, 2 * len(self.inputs)), 6 * HIDDEN), np.float32)
                grown[:self.used] = self.inputs[:self.used]
                self.inputs = grown
            self.inputs[self.used:need] = made
            self.known.update(zip(missing, range(self.used, need)))
            self.used = need
        total = sum(map(len, texts))
        return np.fromiter((place for words in texts for place in map(self.known.__getitem__, words)), np.int64, total)

    def window_logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, start and logit of all windows of all texts."""
        sizes = np.array([len(words) for words in texts], np.int64)
        places = np.append(self._places(texts), np.zeros(WINDOW, np.int64))
        begins = np.append(0, np.cumsum(sizes))
        starts = [windows(n) for n in sizes]
        owner = np.repeat(np.arange(len(texts)), [len(one) for one in starts])
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        logits = np.zeros(len(owner), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for low in range(0, len(owner), GROUP):
            own, first = owner[low:low + GROUP], start[low:low + GROUP]
            mask = steps < (sizes[own] - first)[None, :]
            at = np.where(mask, places[np.minimum((begins[own] + first)[None, :] + steps, len(places) - 1)], 0)
            logits[low:low + GROUP] = self.network.logits(self.inputs[at], mask)
        return owner, start, logits

    def highest(self, texts: list[list[bytes]]) -> np.ndarray:
        """The highest window logit of each text, NaN without words."""
        out = np.full(len(texts), np.nan)
        group, size, first = [], 0, 0
        for i, words in enumerate([*texts, None]):
            if words is not None:
                group.append(words)
                size += len(words)
            if group and (words is None or size >= GROUP_WORDS):
                owner, _, logits = self.window_logits(group)
                best = np.full(len(group), -np.inf)
                np.maximum.at(best, owner, logits)
                out[first:first + len(group)] = np.where(np.isfinite(best), best, np.nan)
                group, size, first = [], 0, i + 1
        return out

    def probabilities(self, texts: list[list[bytes]]) -> np.ndarray:
        best = self.highest(texts)
        p = _sigmoid(self.network.scale * best + self.network.shift)
        return np.where(np.isnan(p), 0.0, p)


def _log_odds(texts: list[list[bytes]], toxic: np.ndarray):
    """Log odds of word rows and run rows to be in toxic documents."""
    words, runs = np.zeros((2, WORD_ROWS)), np.zeros((2, RUN_ROWS))
    for said, label in zip(texts, toxic):
        if said:
            own = list(set(said))
            words[int(label), np.unique(np.fromiter(map(word_row, own), np.int64))] += 1
            runs[int(label), np.unique(run_hashes(own)[0])] += 1
    n = np.bincount(toxic.astype(int), minlength=2)[:, None]

    def ratio(counts):
        total = counts.sum(0)
        return (np.diff(np.log((counts + 0.5) / (n + 1)), axis=0)[0] * total / (total + RARE)).astype(np.float32)

    return ratio(words), ratio(runs)


def train(texts: list[list[bytes]], toxic: np.ndarray, seed: int = 5) -> Network | None:
    """A network from documents (lists of words) and their labels; None if one kind is missing."""
    own = np.array([bool(words) for words in texts], bool)
    texts, toxic = [words for words in texts if words], np.asarray(toxic, bool)[own]
    if toxic.all() or not toxic.any():
        return None
    network, draw = Network(seed), np.random.default_rng(seed)
    word_odds, run_odds = _log_odds(texts, toxic)
    # what is known from counting is where training begins
    network.p["words"][:, 0] = word_odds / 4
    network.p["runs"][:, 0] = run_odds / 4
    squares = {name: np.full_like(value, 1e-3) for name, value in network.p.items()}
    for turn in range(ROUNDS):
        chosen = _blamed(network if turn else None, texts, toxic, word_odds, run_odds, draw)
        weight = np.where([toxic[i] for i, _ in chosen], sum(not toxic[i] for i, _ in chosen) / max(1, sum(toxic[i] for i, _ in chosen)), 1.0)
        weight = np.minimum(weight, 4.0)
        for _ in range(EPOCHS):
            order = draw.permutation(len(chosen))
            for low in range(0, len(order), BATCH):
                part = order[low:low + BATCH]
                said = [texts[chosen[i][0]][chosen[i][1]:chosen[i][1] + WINDOW] for i in part]
                words = list(dict.fromkeys(word for one in said for word in one))
                place = {word: i for i, word in enumerate(words)}
                at, mask = np.zeros((WINDOW, len(part)), np.int64), np.zeros((WINDOW, len(part)), bool)
                for column, one in enumerate(said):
                    at[:len(one), column], mask[:len(one), column] = [place[word] for word in one], True
                truth = np.array([toxic[chosen[i][0]] for i in part], np.float32)
                # half of the words are known by their runs only, as unseen words will be
                _, g = network.gradients(words, at, mask, truth, weight[part].astype(np.float32), draw.random(len(words)) < 0.5)
                for name, gradient in g.items():
                    _step(network.p[name], squares[name], gradient)
    network.scale, network.shift = _logistic(Scorer(network).highest(texts), toxic)
    return network


def _step(value: np.ndarray, square: np.ndarray, gradient) -> None:
    if isinstance(gradient, tuple):
        rows, where = np.unique(gradient[0], return_inverse=True)
        summed = np.zeros((len(rows), value.shape[1]), np.float32)
        np.add.at(summed, where, gradient[1])
        square[rows] += summed * summed
        value[rows] -= RATE * summed / np.sqrt(square[rows])
    else:
        square += gradient * gradient
        value -= RATE * gradient / np.sqrt(square)


def _blamed(network, texts, toxic, word_odds, run_odds, draw) -> list[tuple[int, int]]:
    """(document, start) of training windows: the highest of each, and others of clean documents."""
    if network is not None:
        owner, start, score = Scorer(network).window_logits(texts)
    else:
        owner, start, score = [], [], []
        for i, words in enumerate(texts):
            runs, edges = run_hashes(words)
            odds = word_odds[np.fromiter(map(word_row, words), np.int64, len(words))] + np.maximum.reduceat(run_odds[runs], edges[:-1])
            for a in windows(len(words)).tolist():
                owner.append(i)
                start.append(a)
                score.append(float(odds[a:a + WINDOW].max()))
        owner, start, score = np.array(owner), np.array(start), np.array(score)
    order = np.lexsort((-score, owner))
    nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    pick = order[nth < np.where(toxic[owner[order]], 1, 2)]
    clean = np.flatnonzero(~toxic[owner])
    extra = draw.choice(clean, min(len(clean), CLEAN_WINDOWS * len(texts)), replace=False)
    return [(int(owner[i]), int(start[i])) for i in np.unique(np.concatenate([pick, extra]))]


def _logistic(value: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve by Newton steps, shrunk towards the network's own."""
    x = np.stack([value, np.ones_like(value)], 1)
    own = np.array([1.0, 0.0])
    w = own.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - truth) / len(truth) + 1e-2 * (w - own)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(truth) + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, gradient), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, bound: int = SAMPLE_ROWS) -> Network | None:
    """A network from at most ``bound`` labelled documents; which ones, a hash of their ids says."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = (known if training is None else known.filter(training)).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = {kind: min(1.0, 0.97 * (bound / 2) / n) for kind, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = known.filter(F.when(F.col("toxic"), place < int(shares.get(True, 1) * (1 << 30))).otherwise(place < int(shares.get(False, 1) * (1 << 30))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").filter(
        F.char_length("text") <= SAMPLE_CHARS)
    # one text of each picked id, so that the bound holds for rows too
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(texts.select("doc_id", "text", "toxic").collect(), key=lambda r: (r["doc_id"], r["text"]))
    return train([words_of(r["text"]) for r in rows], np.array([r["toxic"] for r in rows], bool))


def scored(rows: DataFrame, network: Network | None) -> DataFrame:
    """_key, doc_id and score of keyed rows."""
    shared = by_value(rows.sparkSession, network)

    def run(batches):
        known = opened(shared)
        scorer = Scorer(known) if known is not None else None
        for batch in batches:
            parts, group, size = [np.zeros(0)], [], 0
            # few texts are held as words at a time
            for text in batch.column("text"):
                group.append(words_of(text.as_py()))
                size += len(group[-1])
                if size >= GROUP_WORDS:
                    parts.append(scorer.probabilities(group) if scorer else np.zeros(len(group)))
                    group, size = [], 0
            parts.append(scorer.probabilities(group) if scorer else np.zeros(len(group)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY), batch.column("doc_id"), pa.array(np.concatenate(parts).astype(float))],
                [KEY, "doc_id", "score"])

    return rows.select(KEY, "doc_id", "text").mapInArrow(released(run), f"{KEY} long, doc_id long, score double")


def in_training() -> Column:
    return id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT


def report(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    network = fit(docs, labels, in_training(), bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(KEY, F.lit(0).cast("long"))
    return scored(rows, network).select(
        "doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are not taken for toxic, with all their columns."""
    network = fit(docs, labels, in_training(), bound)
    rows = keyed_whole(docs)
    with small_batches(docs.sparkSession):  # the keys to leave out are found here
        return without(rows, scored(rows, network).filter("score >= 0.5"))


