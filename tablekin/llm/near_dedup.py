"""Near-duplicates by Order MinHash.

Words: A-Z in lower case, runs of characters outside ASCII punctuation, blanks and control characters.
k-mers are runs of five words with their occurrence number, so that all of a text differ. A
sketch takes the 8 smallest k-mers of a text by one random order and keeps them in text order; documents that
share one of 40 sketches are candidates: 99.9 % of those with similarity 0.8, 0.3 % of those with
similarity 0.3, as texts that share a passage have it. Texts of few k-mers have 12 sketches of two k-mers.

Candidates are verified by banded alignment of their k-mers: with a k-mers aligned in order out of n and
m, the similarity a / (n + m - a) must be 0.8 or more; such an alignment never leaves the band of
(n + m) / 9 around the diagonal. Documents of equal words are one class from the start. Classes are
the connected components of the verified links: first each document is aligned with the smallest document
of the bucket they share most often; then, in every bucket that still holds two classes, shared k-mers are
counted for all members by matrix products, and those with enough are aligned unless they are
connected by then. No pair becomes a row, and large buckets are split into groups of bounded size.

Null and empty texts have no words and are near nothing; texts under five words only equal texts.
Repeated rows are copies; rows that share a doc_id or have none are told apart by their text. Other
columns are ignored.
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import KEY, keyed, keyed_whole, released, shipped, small_batches, stage, without
from tablekin.llm.components import components

shipped(__name__)

WORDS, TAKEN, SKETCHES = 5, 8, 40
# texts of few k-mers have sketches of two; texts between the bounds have both, so that all pairs of
# similarity 0.8 have one kind in common
SHORT_TAKEN, SHORT_SKETCHES, SHORT_UPTO, LONG_FROM = 2, 12, 24, 16
# ids of candidates that are broadcast to pick their texts (8 bytes each); more are found by a join
BROADCAST_IDS = 2_000_000
GROUP = 1_000  # rows of a bucket that are compared in one task; larger buckets make several groups
COLUMNS = 4096  # k-mers counted at once
MEMORY_WORDS = 200_000  # word hashes a task remembers

_random = np.random.default_rng(20190712)
SEEDS = _random.integers(1, 2**63, SKETCHES, dtype=np.uint64)
ODD = _random.integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0xD6E8FEB86659FD93)
TRANSLATE = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TRANSLATE).split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STEP
    return h ^ (h >> np.uint64(32))


def labelled_kmers(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Hashes of (k-mer, how often it came before), in text order."""
    n = len(words) - WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    kmers = ids[:n].copy()
    for i in range(1, WORDS):
        kmers = _mixed(kmers * STEP + ids[i:n + i])
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    same = np.append(False, ordered[1:] == ordered[:-1])
    if same.any():
        start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        seen = np.empty(n, np.uint64)
        seen[order] = (np.arange(n) - start).astype(np.uint64)
        kmers = _mixed(kmers + seen * STEP)
    return kmers


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One hash per sketch, of its smallest k-mers in text order."""
    families = []
    if len(kmers) <= SHORT_UPTO:
        families.append(_sketch(kmers, slice(0, SHORT_SKETCHES), SHORT_TAKEN))
    if len(kmers) > 4096:
        families += [_sketch(kmers, slice(i, i + 1), TAKEN) for i in range(SKETCHES)]
    elif len(kmers) >= LONG_FROM:
        families.append(_sketch(kmers, slice(0, SKETCHES), TAKEN))
    return np.concatenate(families)


def _sketch(kmers: np.ndarray, which: slice, size: int) -> np.ndarray:
    if len(kmers) > size:
        ranks = (kmers ^ SEEDS[which, None]) * ODD[which, None]
        ranks ^= ranks >> np.uint64(32)
        at = np.sort(np.argpartition(ranks, size - 1, axis=1)[:, :size], axis=1)
        taken = kmers[at]
    else:
        taken = np.broadcast_to(kmers, (len(SEEDS[which]), len(kmers)))
    out = SEEDS[which].copy()
    for column in range(taken.shape[1]):
        out = _mixed(out * STEP + taken[:, column])
    return out.view(np.int64)


def _sketched(batches):
    hashes = WordHashes()
    for batch in batches:
        keys, texts = batch.column(KEY), batch.column("text")
        same, made = [], []
        for text in texts:
            words = words_of(text.as_py())
            same.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            kmers = labelled_kmers(words, hashes)
            made.append(sketches(kmers) if len(kmers) else np.zeros(0, np.int64))
        offsets = np.append(0, np.cumsum([len(one) for one in made])).astype(np.int32)
        values = np.concatenate(made) if made else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(same, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(values))], [KEY, "same", "buckets"])


def _kmers_of(known: np.ndarray | None):
    """(node, kmers) of the known rows, of all if None; 32 bits of each k-mer."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            keys = batch.column(KEY).to_numpy(zero_copy_only=False)
            pick = np.ones(len(keys), bool) if known is None else np.isin(keys, known)
            made = [labelled_kmers(words_of(batch.column("text")[int(i)].as_py()), hashes) for i in np.flatnonzero(pick)]
            offsets = np.append(0, np.cumsum([len(one) for one in made])).astype(np.int32)
            values = (np.concatenate(made) if made else np.zeros(0, np.uint64)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[pick].astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(values))], ["node", "kmers"])

    return run


def aligned(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the k-mers of two texts align to a similarity of 0.8 or more."""
    n, m = len(x), len(y)
    enough = -(-4 * (n + m) // 9)  # a / (n + m - a) >= 0.8
    if min(n, m) < enough:
        return False
    _, at, to = np.intersect1d(x, y, return_indices=True)
    band = (n + m) // 9
    near = np.abs(at - to) <= band
    at, to = at[near], to[near]
    if len(at) < enough:
        return False
    to = to[np.argsort(at, kind="stable")]
    if (np.diff(to) > 0).all():
        return True
    # the longest increasing run of places is the alignment
    ends: list[int] = []
    for place in to.tolist():
        i = bisect_left(ends, place)
        ends[i:i + 1] = [place]
    return len(ends) >= enough


def _verified(batches):
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        hit = pa.array([aligned(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(x, y)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(hit)


def _verify(pairs: DataFrame, kmers: DataFrame) -> DataFrame:
    side = lambda node, name: kmers.select(F.col("node").alias(node), F.col("kmers").alias(name))
    return stage(pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")
                 .mapInArrow(released(_verified), "a long, b long"))


def common_counts(kmers: list[np.ndarray]) -> np.ndarray:
    """How many k-mers each two texts share; only those of two texts or more are looked at."""
    n = len(kmers)
    owner = np.repeat(np.arange(n), [len(one) for one in kmers])
    known, column, times = np.unique(np.concatenate(kmers), return_inverse=True, return_counts=True)
    column = (np.cumsum(times > 1) - 1)[column], times[column] > 1
    column, owner = column[0][column[1]], owner[column[1]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    counts = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        has = np.zeros((n, COLUMNS), np.float32)
        has[owner[part], column[part] - low] = 1
        counts += has @ has.T
    return counts


def group_links(nodes: list[int], classes_: list[int], kmers: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between texts of different classes; pairs that earlier links connect are left out."""
    root = {one: one for one in classes_}

    def find(one):
        while root[one] != one:
            root[one] = one = root[root[one]]
        return one

    sizes = np.array([len(one) for one in kmers])
    own = np.array(classes_)
    near = 9 * common_counts(kmers) >= 4 * (sizes[:, None] + sizes[None, :])
    links = []
    for i, j in np.argwhere(np.triu(near & (own[:, None] != own[None, :]), 1)).tolist():
        a, b = find(classes_[i]), find(classes_[j])
        if a != b and aligned(kmers[i], kmers[j]):
            root[a] = b
            links.append((nodes[i], nodes[j]))
    return links


def _grouped(batches):
    """Links of each group; the rows of a group follow each other."""
    key, held = None, []

    def links():
        found = group_links(*zip(*held)) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([one[i] for one in found], pa.int64()) for i in range(2)], ["a", "b"])

    for batch in batches:
        rows = zip(*[batch.column(name).to_pylist() for name in ("bucket", "low", "high", "node", "class")], batch.column("kmers"))
        for *group, node, own, kmers in rows:
            if group != key:
                yield links()
                key, held = group, []
            held.append((node, own, kmers.values.to_numpy()))
    yield links()


def _open_groups(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold two classes, in groups of bounded size.

    Of buckets with equal members one stays. A bucket of more than GROUP rows is dealt into parts
    by a hash, and each two parts are a group.
    """
    labelled = stage(shared.join(components(edges), "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("class")))
    members = labelled.groupBy("bucket").agg(
        F.min("class").alias("first"), F.max("class").alias("last"), F.count("*").alias("n"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.min("node").alias("least"), F.max("node").alias("most"))
    kinds = members.filter("first <> last").groupBy("n", "sum", "least", "most").agg(F.min("bucket").alias("bucket"))
    parts = F.ceil(F.col("n") / GROUP)
    dealt = labelled.join(kinds.select("bucket", parts.alias("parts")), "bucket").withColumn(
        "part", F.pmod(F.xxhash64("node"), "parts"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: o != F.col("part")))
    return dealt.withColumn("other", F.explode(others)).select(
        "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "class")


def find_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect each class; ``nodes`` has (node, buckets), one per distinct text."""
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    reps = rows.groupBy("bucket").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    shared = stage(rows.join(reps.select("bucket", "rep"), "bucket").select("bucket", "node", "rep"))
    candidates = shared.select("node").distinct()
    known = None
    if candidates.count() <= BROADCAST_IDS:
        known = np.sort(candidates.toPandas()["node"].to_numpy(np.int64))
    kmers = texts.mapInArrow(released(_kmers_of(known)), "node long, kmers array<int>")
    kmers = stage(kmers if known is not None else kmers.join(candidates, "node", "left_semi"))
    # first the smallest document of the bucket shared most often
    met = shared.filter("node <> rep").groupBy("node", "rep").count()
    best = met.groupBy("node").agg(F.max(F.struct("count", (-F.col("rep")).alias("least"))).alias("best"))
    edges = _verify(best.select((-F.col("best.least")).alias("a"), F.col("node").alias("b")), kmers)
    # then whatever shares a bucket and is in another class
    groups = _open_groups(shared.select("bucket", "node"), edges).join(kmers, "node")
    order = ["bucket", "low", "high"]
    more = groups.repartition(*order).sortWithinPartitions(*order, "node").select(*order, "node", "class", "kmers")
    return edges.unionByName(stage(more.mapInArrow(released(_grouped), "a long, b long")))


def classes(rows: DataFrame) -> DataFrame:
    """Of keyed rows: _key, doc_id, class_id (doc_id of the first document of the class) and kept (is that document)."""
    texts = rows.select(KEY, "text")
    with small_batches(rows.sparkSession):  # all that passes texts or k-mers to Python is kept as stages
        sketched = stage(texts.mapInArrow(released(_sketched), f"{KEY} long, same binary, buckets array<long>"))
        equal = sketched.filter("same is not null").groupBy("same").agg(F.min(KEY).alias("node"))
        nodes = sketched.join(equal.select(F.col("node").alias(KEY)), KEY, "left_semi").select(F.col(KEY).alias("node"), "buckets")
        links = find_links(nodes, texts)
    roots = components(links)
    first = roots.groupBy("root").agg(F.min("node").alias("first"))
    of_node = equal.join(roots.join(first, "root").select("node", "first"), "node", "left").select(
        "same", F.coalesce("first", "node").alias("first"))
    member = sketched.select(KEY, "same").join(of_node, "same", "left").select(
        KEY, F.coalesce("first", KEY).alias("first"))
    ids = rows.select(KEY, "doc_id")
    named = ids.select(F.col(KEY).alias("first"), F.col("doc_id").alias("class_id"))
    return ids.join(member, KEY).join(named, "first").select(
        KEY, "doc_id", "class_id", (F.col(KEY) == F.col("first")).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept of every document."""
    return classes(keyed(docs, "text")).select("doc_id", "class_id", "kept")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The first document of each class, with all its columns."""
    rows = keyed_whole(docs)
    return without(rows, classes(rows).filter("not kept"))
