"""Scores of texts by context-tree weighting over bytes, beside a smoothed unigram base.

Every byte is eight binary decisions; each decision has a tree of contexts: none, the last byte, the last
two, up to the last six. Every node of it estimates its decision from its counts (Krichevsky-Trofimov), and
weighting mixes a node with what stands below it by how well each has coded the training texts.
All counts follow from those of seven neighbouring bytes, which Spark sums over the whole corpus; they stay rows
and grow with it. Rows of the same last three bytes meet in one task, which weights depths six to
three for all of them; what reaches depth two is summed by Spark, and the tree above it (2^16 contexts at most)
is weighted on the driver. Values of frequent runs of seven bytes are broadcast up to a bound; the others meet the texts
that hold them in a join, summed by text and run before it. Contexts never seen are left out of
the mixture. A text is read after six zero bytes and ends with the byte 255, which
UTF-8 never has; its score is the log10 probability of all that.

The base counts tokens (A-Z in lower case, runs outside ASCII white space, one end per text) of
the training texts. Counts of frequent tokens are broadcast up to a bound; the others meet the
texts that hold them in a join, summed by text and token before it.

Training texts are those whose crc32(doc_id as text) mod 7 is not 2; a null id counts as empty
text. Null texts are empty. Repeated rows are scored (and learned from) one by one; without training
texts all bytes are equally likely. Other columns are ignored.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import KEY, id_remainder, keyed, released, shipped, stage

shipped(__name__)

MODULUS, HELD_OUT = 7, 2
START, END = 0, 255
CONTEXTS, BYTES = 1 << 16, 256
CHUNK = 1 << 20
FREQUENT_TOKENS = 1 << 18  # tokens in the broadcast table, some 20 bytes each
COUNTED_TOKENS = 1 << 18  # distinct tokens a task counts before it passes them on
COUNTED_TRIPLES = 1 << 21
DEPTH = 6  # with the byte itself seven bytes, which a long holds
FREQUENT_RUNS = 1 << 21  # runs of seven bytes in the broadcast table, 12 bytes each
COUNTED_RUNS = 1 << 22  # distinct runs a task counts before it passes them on
SUBTREE_ROWS = 1 << 18  # rows weighted at once, more if a context of three bytes has more


def framed(texts: list[bytes], depth: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """All texts with their start and end bytes in one array, and where each starts."""
    joined = b"".join([b"\x00" * depth + text + b"\xff" for text in texts])
    starts = np.append(0, np.cumsum([len(text) + depth + 1 for text in texts])).astype(np.int64)
    return np.frombuffer(joined, np.uint8), starts


def _triples(data: np.ndarray) -> np.ndarray:
    """Code of each byte with the two before it: last but one, last, own."""
    wide = data.astype(np.uint32)
    return (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]


def _runs(data: np.ndarray) -> np.ndarray:
    """Code of each byte with the six before it: last, last but one, and so on, own; in order, contexts of any
    depth are neighbours."""
    n = len(data) - DEPTH
    code = np.zeros(n, np.int64)
    for at in [*range(DEPTH - 1, -1, -1), DEPTH]:
        code <<= 8
        code |= data[at:at + n]
    return code


def _inner(starts: np.ndarray, total: int, depth: int = 2) -> np.ndarray:
    """Which triples (runs) lie within one text."""
    mask = np.ones(total - depth, bool)
    for before in range(1, depth + 1):
        mask[starts[1:-1] - before] = False
    return mask


def _groups(texts):
    """Texts in groups of about CHUNK bytes."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _bytes_of(column: pa.Array):
    return ((value.as_py() or b"") for value in column.cast(pa.large_binary()))


def triple_counts(texts: DataFrame) -> DataFrame:
    """(code, n) of all byte triples; a task passes its sums on when it is done or holds many."""

    def count(batches):
        codes, sums = [], []

        def merged():
            every = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            known, where = np.unique(every, return_inverse=True)
            total = np.bincount(where, np.concatenate(sums) if sums else [], len(known)).astype(np.int64)
            return known, total

        def rows(known, total):
            return pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(total)], ["code", "n"])

        for batch in batches:
            for group in _groups(_bytes_of(batch.column("text"))):
                data, starts = framed(group)
                for low in range(0, len(data) - 2, CHUNK):
                    part = _triples(data[low:low + CHUNK + 2])[_inner(starts, len(data))[low:low + CHUNK]]
                    code, n = np.unique(part, return_counts=True)
                    codes.append(code)
                    sums.append(n)
            if len(codes) >= 16:
                known, total = merged()
                codes, sums = [known], [total]
            if sum(map(len, codes)) > COUNTED_TRIPLES:
                yield rows(*merged())
                codes, sums = [], []
        yield rows(*merged())

    return texts.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _bit_nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 inner nodes of the byte tree, by level."""
    level, zeros, ones = counts, [], []
    while level.shape[1] > 1:
        zeros.append(level[:, 0::2])
        ones.append(level[:, 1::2])
        level = zeros[-1] + ones[-1]
    return np.concatenate(zeros[::-1], 1), np.concatenate(ones[::-1], 1)


_LOG_GAMMA = np.frompyfunc(math.lgamma, 1, 1)


def _log_gamma(values: np.ndarray) -> np.ndarray:
    """lgamma of halves and whole numbers; each different value is worked out once."""
    known, where = np.unique(values, return_inverse=True)
    return _LOG_GAMMA(known).astype(float)[where].reshape(values.shape)


def _block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _byte_log10(one: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probabilities of ones at the 255 nodes."""
    out, at = np.zeros((len(one), 1)), 0
    for level in range(8):
        p = one[:, at:at + (1 << level)]
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], 2).reshape(len(one), -1)
        at += 1 << level
    return out


def run_logs(model: dict[str, np.ndarray], codes: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log10 P(last byte of each run | the six before), from what longer contexts give each of its decisions.

    ``model`` has the arrays of a Model.
    """
    row = model["rows"][(codes >> 40 & 255) << 8 | codes >> 48]
    out = np.zeros(len(codes))
    for level in range(8):
        node = (1 << level) - 1 + ((codes & 255) >> (8 - level))
        bit = codes >> (7 - level) & 1
        p = model["ends"][bit, row, node].astype(float)
        known = np.flatnonzero(~np.isnan(below[:, level]))
        at = bit[known], row[known], node[known]
        p[known] = model["above"][at] + model["reach"][at[1:]] * below[known, level].astype(float)
        out += np.log10(p)
    return out


class Model:
    """log10 P(byte | last two bytes): a row per seen pair, per last byte, and one without context.

    ``deeper`` (pairs, nodes, ln of what stands below them) puts the tree of longer contexts under it; ``ends`` are then
    the probabilities of zero and one where no longer context is known, else ``above`` and ``reach`` say what the two
    bytes give and how much of the longer contexts' own probability counts.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, deeper: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        codes = codes.astype(np.int64)
        pairs, where = np.unique(codes >> 8, return_inverse=True)
        two = np.zeros((len(pairs), BYTES))
        np.add.at(two, (where, codes & 255), counts)
        last = pairs & 255
        one = np.zeros((BYTES, BYTES))
        np.add.at(one, last, two)
        none = one.sum(0, keepdims=True)
        bits = [_bit_nodes(level) for level in (none, one, two)]
        blocks = [_block(*level) for level in bits]
        estimates = [_one(*level) for level in bits]
        half = math.log(0.5)
        weighted_two = blocks[2]
        if deeper is not None:
            lower = np.zeros_like(blocks[2])
            lower[np.searchsorted(pairs, deeper[0]), deeper[1]] = deeper[2]
            weighted_two = half + np.logaddexp(blocks[2], lower)
        below = np.zeros_like(blocks[1])
        np.add.at(below, last, weighted_two)
        weighted = half + np.logaddexp(blocks[1], below)
        stay_one = np.exp(half + blocks[1] - weighted)
        unseen = bits[1][0] + bits[1][1] == 0
        stay_none = np.exp(blocks[0] - np.logaddexp(blocks[0], np.where(unseen, 0.0, weighted).sum(0, keepdims=True)))
        # from the deepest seen context up
        seen = bits[2][0] + bits[2][1] > 0
        mixed_two = np.where(seen, stay_one[last] * estimates[1][last] + (1 - stay_one[last]) * estimates[2], estimates[1][last])
        top = lambda lower, known: np.where(known, stay_none * estimates[0] + (1 - stay_none) * lower, estimates[0])
        known_one = ~unseen
        rows = np.concatenate([top(mixed_two, known_one[last]), top(estimates[1], known_one), estimates[0]])
        if deeper is None:
            self.table = _byte_log10(rows).astype(np.float32)
        else:
            stay_two = np.exp(half + blocks[2] - weighted_two)
            passed = (1 - stay_none) * (1 - stay_one[last])
            above = stay_none * estimates[0] + (1 - stay_none) * stay_one[last] * estimates[1][last] + passed * stay_two * estimates[2]
            self.reach = (passed * (1 - stay_two)).astype(np.float32)
            self.above = np.stack([1 - passed * (1 - stay_two) - above, above]).astype(np.float32)
            self.ends = np.stack([1 - rows, rows]).astype(np.float32)
        self.rows = np.tile(np.arange(BYTES, dtype=np.int32) + len(pairs), BYTES)
        self.rows[pairs] = np.arange(len(pairs), dtype=np.int32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text; by two bytes of context."""
        out = []
        for group in _groups(texts):
            data, starts = framed(group)
            totals = np.zeros(len(group))
            for low in range(0, len(data) - 2, CHUNK):
                code = _triples(data[low:low + CHUNK + 2])
                bits = self.table[self.rows[code >> 8], code & 255].astype(float)
                bits[~_inner(starts, len(data))[low:low + CHUNK]] = 0.0
                first = int(np.searchsorted(starts, low, "right")) - 1
                edges = np.clip(starts[first:] - low, 0, len(bits))
                edges = edges[:int(np.searchsorted(edges, len(bits)))]
                totals[first:first + len(edges)] += np.add.reduceat(bits, edges)
            out.append(totals)
        return np.concatenate(out) if out else np.zeros(0)


_KNOWN_GAMMA = 1 << 12
_HALVES = np.array([math.lgamma(i + 0.5) for i in range(_KNOWN_GAMMA)])
_WHOLES = np.array([math.lgamma(i + 1.0) for i in range(_KNOWN_GAMMA)])


def _gamma(known: np.ndarray, counts: np.ndarray, more: float) -> np.ndarray:
    """lgamma(counts + more), by Stirling's series beyond the table."""
    out = known[np.minimum(counts, _KNOWN_GAMMA - 1)]
    big = np.flatnonzero(counts >= _KNOWN_GAMMA)
    if len(big):
        x = counts[big] + more
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return out


def _summed(codes: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different codes in order and their sums."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)])
    return ordered[first], *[np.add.reduceat(one[order], first) if len(first) else one[:0] for one in sums]


def _absorb(held: list[np.ndarray], waiting: list[tuple]) -> None:
    """Adds the waiting sums to the held ones in place; only what is new makes longer arrays, one at a time."""
    if not waiting:
        return
    codes, *sums = _summed(*map(np.concatenate, zip(*waiting)))
    waiting.clear()
    at = np.searchsorted(held[0], codes)
    known = at < len(held[0])
    known[known] = held[0][at[known]] == codes[known]
    for one, more in zip(held[1:], sums):
        one[at[known]] += more[known]
    fresh = ~known
    at = at[fresh]
    for i, more in enumerate([codes, *sums]):
        held[i] = np.insert(held[i], at, more[fresh])


def run_counts(rows: DataFrame) -> DataFrame:
    """(code, n, m) of all runs of seven bytes: how often training texts and all texts hold them; rows of the same last
    three bytes of context are in one partition."""

    def count(batches):
        def empty():
            return [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]

        held, waiting = empty(), []

        def made(held):
            # passed on in slices, so that no second copy of all is made
            for low in range(0, max(1, len(held[0])), SUBTREE_ROWS):
                codes, n, m = (one[low:low + SUBTREE_ROWS] for one in held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes >> 32), pa.array(codes), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))],
                    ["top", "code", "n", "m"])

        for batch in batches:
            left_out = batch.column("held_out").to_pylist()
            for kind in (False, True):
                for group in _groups(t for t, out in zip(_bytes_of(batch.column("text")), left_out) if out == kind):
                    data, starts = framed(group, DEPTH)
                    inner = _inner(starts, len(data), DEPTH)
                    for low in range(0, len(data) - DEPTH, CHUNK):
                        part = _runs(data[low:low + CHUNK + DEPTH])[inner[low:low + CHUNK]]
                        part.sort()
                        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
                        times = np.diff(np.append(first, len(part)))
                        times = times.astype(np.int32)
                        waiting.append((part[first], times * (not kind), times))
                        del part, first, times
                        if sum(len(one[0]) for one in waiting) >= SUBTREE_ROWS * 2:
                            _absorb(held, waiting)
                            if len(held[0]) > COUNTED_RUNS:
                                yield from made(held)
                                held = empty()
        _absorb(held, waiting)
        yield from made(held)

    return (rows.select("held_out", "text").mapInArrow(released(count), "top long, code long, n long, m long").repartition("top")
            .groupBy("top", "code").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def weigh(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The tree of contexts of three to six bytes over runs in order, whole contexts of three bytes at a time.

    For each run the probabilities that this tree gives the eight decisions of its last byte (NaN where three bytes of
    context were never seen), and (last two bytes, node) with the sum of ln weighted probabilities below it.
    """
    half = math.log(0.5)
    keys, counts, parents = [codes], [n], []
    for _ in range(DEPTH - 3):
        shorter = keys[-1] >> 16 << 8 | keys[-1] & 255
        known, where = np.unique(shorter, return_inverse=True)
        keys.append(known)
        parents.append(where)
        counts.append(np.bincount(where, counts[-1], len(known)).astype(np.int64))
    out, tops, sums = np.empty((len(codes), 8)), [], []
    for level in range(8):
        nodes, levels, below = [], [], None
        for at, (key, count) in enumerate(zip(keys, counts)):
            node = key >> (8 - level)
            new = np.append(True, node[1:] != node[:-1])
            first = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            if at:
                up = number[parents[at - 1][levels[-1][0]]]
                levels[-1] = *levels[-1][1:], up
                below = np.bincount(up, below, len(first))
            ones = np.add.reduceat(count * (key >> (7 - level) & 1), first)
            total = np.add.reduceat(count, first)
            block = _gamma(_HALVES, total - ones, 0.5) + _gamma(_HALVES, ones, 0.5) - _gamma(_WHOLES, total, 1.0) - math.log(math.pi)
            weighted = half + np.logaddexp(block, below) if at else block
            nodes.append(number)
            levels.append((first, (ones + 0.5) / (total + 1.0), total > 0, np.exp(half + block - weighted)))
            below = weighted
        # two bytes and the node in the byte's own tree
        seen = keys[-1][levels[-1][0]] >> (8 - level)
        tops.append((seen >> (8 + level)) << 8 | (1 << level) - 1 + (seen & (1 << level) - 1))
        sums.append(below)
        _, estimate, known, stay = levels[-1]
        final, gone, reach = np.where(known, estimate, np.nan), stay * estimate, 1 - stay
        for estimate, known, stay, up in levels[-2::-1]:
            final = np.where(known, gone[up] + reach[up] * estimate, final[up])
            gone, reach = gone[up] + reach[up] * stay * estimate, reach[up] * (1 - stay)
        one = final[nodes[0]]
        out[:, level] = np.where(codes >> (7 - level) & 1, one, 1 - one)
    return out, _summed(np.concatenate(tops), np.concatenate(sums))


SUBTREES = "code long, n long, m long, below array<float>, top long, weighted double"


def subtrees(counts: DataFrame) -> DataFrame:
    """Rows of runs (code, n, m, below) and of sums for the tree above (top, weighted)."""
    names = [field.split(" ")[0] for field in SUBTREES.split(", ")]

    def done(held):
        codes, n, m = map(np.concatenate, zip(*held))
        below, (top, weighted) = weigh(codes, n)
        edges = pa.array(np.arange(0, 8 * len(codes) + 1, 8, dtype=np.int32))
        lists = pa.ListArray.from_arrays(edges, pa.array(below.astype(np.float32).ravel()))
        none = lambda kind, size: pa.nulls(size, kind)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n), pa.array(m), lists, none(pa.int64(), len(codes)),
                                          none(pa.float64(), len(codes))], names)
        yield pa.RecordBatch.from_arrays([none(pa.int64(), len(top))] * 3 + [none(lists.type, len(top)), pa.array(top), pa.array(weighted)], names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            new = tuple(batch.column(name).to_numpy() for name in ("code", "n", "m"))
            if size >= SUBTREE_ROWS and len(new[0]):
                # up to the last context that this batch ends
                context = new[0] >> 32
                cut = 0 if context[0] != held[-1][0][-1] >> 32 else int(np.searchsorted(context, context[0], "right"))
                if cut < len(context):
                    yield from done([*held, tuple(one[:cut] for one in new)])
                    held, size, new = [], 0, tuple(one[cut:] for one in new)
            if len(new[0]):
                held.append(new)
                size += len(new[0])
        if held:
            yield from done(held)

    return counts.sortWithinPartitions("code").select("code", "n", "m").mapInArrow(released(run), SUBTREES)


class RunTable:
    """Values of runs by their code."""

    ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values
        bits = max(4, int(2 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, left = [], np.arange(len(codes), dtype=np.int32)
        for odd in self.ODD:
            slot, held = self._slot(codes[left], odd), np.zeros(1 << bits, np.int32)
            held[slot] = left
            left = left[held[slot] != left]
            self.slots.append(held)
        order = left[np.argsort(codes[left])]
        self.rest, self.rest_at = codes[order], order

    def _slot(self, codes, odd):
        return codes.view(np.uint64) * odd >> self.shift

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the codes (0 for those not held) and where codes are that are not."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        if not len(self.codes):
            return out, left
        for odd, held in zip(self.ODD, self.slots):
            part = codes[left]
            at = held[self._slot(part, odd)]
            hit = self.codes[at] == part
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, codes[left]), len(self.rest) - 1)
            hit = self.rest[at] == codes[left]
            out[left[hit]] = self.values[self.rest_at[at[hit]]]
            left = left[~hit]
        return out, left

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the values a text's runs have here; owner, code and number of its other runs."""
        totals, rest, before = [], [], 0
        for group in _groups(texts):
            data, starts = framed(group, DEPTH)
            inner, sums = _inner(starts, len(data), DEPTH), np.zeros(len(group))
            for low in range(0, len(data) - DEPTH, CHUNK):
                where = np.flatnonzero(inner[low:low + CHUNK])
                codes = _runs(data[low:low + CHUNK + DEPTH])[where]
                owner = np.searchsorted(starts, where[[0, -1]] + low, "right") - 1 if len(where) else np.zeros(2, int)
                edges = np.searchsorted(where + low, starts[owner[0]:owner[1] + 2])
                owners = np.repeat(np.arange(owner[0], owner[1] + 1), np.diff(edges))
                values, missing = self.find(codes)
                sums += np.bincount(owners, values, len(group))
                rest.append((owners[missing] + before, codes[missing]))
            totals.append(sums)
            before += len(group)
        if not totals:
            return np.zeros(0), *[np.zeros(0, np.int64)] * 3
        owners, codes = map(np.concatenate, zip(*rest))
        order = np.lexsort((codes, owners))
        owners, codes = owners[order], codes[order]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1]))[:len(codes)])
        return np.concatenate(totals), owners[first], codes[first], np.diff(np.append(first, len(codes)))


def run_model(runs: DataFrame) -> Model:
    """The tree of up to two bytes of context over the weighted trees below."""
    own = (F.col("code").bitwiseAND(255)).alias("own")
    pair = (F.shiftright("code", 40).bitwiseAND(255) * 256 + F.shiftright("code", 48)).alias("pair")
    rows = runs.filter("code is not null and n > 0").groupBy(pair, own).agg(F.sum("n").alias("n")).toArrow()
    sums = runs.filter("top is not null").groupBy("top").agg(F.sum("weighted").alias("weighted")).toArrow()
    pairs, top = rows.column("pair").to_numpy(), sums.column("top").to_numpy()
    own_pair = (top >> 8 & 255) << 8 | top >> 16
    seen = np.isin(own_pair, pairs)  # others are in held-out texts only, with nothing to weigh
    return Model(pairs << 8 | rows.column("own").to_numpy(), rows.column("n").to_numpy(),
                 (own_pair[seen], top[seen] & 255, sums.column("weighted").to_numpy()[seen]))


def run_values(runs: DataFrame, model) -> DataFrame:
    """(code, value) of runs; ``model`` shares the arrays of one, as executors may not know its class."""

    def run(batches):
        for batch in batches:
            codes = batch.column("code").to_numpy()
            below = batch.column("below").flatten().to_numpy().reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(run_logs(model.value, codes, below).astype(np.float32))],
                                             ["code", "value"])

    return runs.select("code", "below").mapInArrow(released(run), "code long, value float")


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) of all words; tasks count before tokens are shuffled."""

    def count(batches):
        held: Counter[bytes] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in _bytes_of(batch.column("text")):
                held.update(tokens_of(text))
                if len(held) > COUNTED_TOKENS:
                    yield rows()
                    held.clear()
        yield rows()

    return texts.select("text").mapInArrow(released(count), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequency_floor(counts: DataFrame, bound: int) -> int | None:
    """The least frequency class whose tokens, with those of all higher ones, stay under the bound."""
    total, floor = 0, None
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > bound:
            break
        floor = row["level"]
    return floor


SCORED = (f"{KEY} long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, base double, score double, "
          "rare array<binary>, times array<int>, runs array<long>, run_times array<int>")


def _scored(frequent, frequent_runs):
    def run(batches):
        known_log, table = frequent.value, RunTable(*frequent_runs.value)
        for batch in batches:
            texts = list(_bytes_of(batch.column("text")))
            n_tokens, known, base, rare, times, edges = [], [], [], [], [], [0]
            for text in texts:
                words = tokens_of(text)
                logs = list(map(known_log.get, words))
                if missing := logs.count(None):
                    others = Counter(word for word, log in zip(words, logs) if log is None)
                    rare += list(others)
                    times += list(others.values())
                    logs = [log for log in logs if log is not None]
                n_tokens.append(len(words) + 1)
                known.append(len(words) - missing)
                base.append(math.fsum(logs))
                edges.append(len(rare))
            edges = pa.array(edges, pa.int32())
            score, owner, runs, run_times = table.scores(texts)
            run_edges = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(KEY), batch.column("doc_id"), batch.column("held_out"),
                 pa.array(list(map(len, texts)), pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                 pa.ListArray.from_arrays(edges, pa.array(rare, pa.binary())),
                 pa.ListArray.from_arrays(edges, pa.array(times, pa.int32())),
                 pa.ListArray.from_arrays(run_edges, pa.array(runs)),
                 pa.ListArray.from_arrays(run_edges, pa.array(run_times.astype(np.int32)))],
                [KEY, "doc_id", "held_out", "n_bytes", "n_tokens", "known", "base", "score", "rare", "times", "runs", "run_times"])

    return run


def fit(training: DataFrame) -> Model:
    """The tree of up to two bytes of context alone, of all training texts."""
    rows = triple_counts(training).toArrow()
    return Model(rows.column("code").to_numpy(), rows.column("n").to_numpy())


def report(docs: DataFrame, bound: int = FREQUENT_TOKENS, run_bound: int = FREQUENT_RUNS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, and bits_per_byte:
    the model's code length by the bytes of the text, null for empty ones."""
    context = docs.sparkSession.sparkContext
    rows = keyed(docs, "text").withColumn("held_out", id_remainder(F.col("doc_id"), MODULUS) == HELD_OUT)
    training = rows.filter(~F.col("held_out"))
    counts = stage(token_counts(training).withColumn("level", F.floor(F.log2("n") * 32)))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    floor = frequency_floor(counts, bound)
    top = counts.filter(F.col("level") >= floor) if floor is not None else counts.limit(0)
    table = top.select("token", "n").toArrow()
    frequent = context.broadcast({
        token: math.log10(count + 1) for token, count in zip(table.column("token").to_pylist(), table.column("n").to_pylist())})
    runs = stage(subtrees(run_counts(rows)))
    model = context.broadcast(vars(run_model(runs)))
    runs = runs.filter("code is not null").withColumn("level", F.floor(F.log2("m") * 32))
    run_floor = frequency_floor(runs, run_bound)
    top_runs = run_values(runs.filter(F.col("level") >= run_floor) if run_floor is not None else runs.limit(0), model).toArrow()
    frequent_runs = context.broadcast((top_runs.column("code").to_numpy(), top_runs.column("value").to_numpy()))
    scored = stage(rows.select(KEY, "doc_id", "held_out", "text").mapInArrow(released(_scored(frequent, frequent_runs)), SCORED))
    others = counts if floor is None else counts.filter(F.col("level") < floor)
    met = scored.select(KEY, F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "token").join(others, "token")
    rare = met.groupBy(KEY).agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_base"), F.sum("times").alias("rare_known"))
    other_runs = run_values(runs if run_floor is None else runs.filter(F.col("level") < run_floor), model)
    rare_runs = scored.select(KEY, F.inline(F.arrays_zip("runs", "run_times"))).withColumnRenamed("runs", "code").join(
        other_runs, "code").groupBy(KEY).agg(F.sum(F.col("run_times") * F.col("value").cast("double")).alias("rare_score"))
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return scored.join(rare, KEY, "left").join(rare_runs, KEY, "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(math.log10(ends + 1))
         - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        score.alias("score"), F.when(F.col("n_bytes") > 0, -score * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
