"""Exact removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

Every 100-byte string holds at least one sampled 32-byte q-gram (an anchor: the smallest hash among
the string's q-grams), and equal strings hold equal anchors at equal offsets. So only suffixes next to
anchors are sorted. The q-gram of an anchor is its initial bucket:

* anchors of one bucket whose surroundings (68 bytes before, 100 from its start) are equal repeat the
  earliest of them in full; these fall out of one shuffle of 64-bit hashes,
* for buckets with different surroundings, the earliest anchor of each surrounding is refined:
  buckets of 64 bytes are ranks of pairs of 32-byte bucket ids (32 bytes apart), buckets of 100 bytes
  are ranks of pairs of the 64-byte bucket ids (36 bytes apart), which are reused by all offsets.

A byte goes if a 100-byte string over it starts earlier too (smaller doc_id, or earlier in the
document). Hashes have 64 bits; strings are taken as equal where all their hashes are.

Null texts are empty, texts under 100 bytes are kept as they are. Rows that share a doc_id or have
none are put in order of their text; repeated rows are copies of the first. Other columns are ignored.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekin.llm.common import KEY, keyed, shipped, stage

shipped(__name__)

GRAM, LENGTH = 32, 100
OFFSETS = LENGTH - GRAM + 1  # windows over one anchor
BEFORE = OFFSETS - 1
CHUNK = 1 << 20  # bytes hashed at once
# buckets with different surroundings that are broadcast (8 bytes each); more are found by a join
BROADCAST_BUCKETS = 4_000_000
# surroundings of one bucket sorted in one task; larger buckets are cut by more of their bytes
SPLIT_BUCKET = 20_000
RANGES = 8
ROWS = 4_000  # surroundings refined at once, more only if one bucket has more

_random = np.random.default_rng(20240229)
BYTE_HASH = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _random.integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(2**64 - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 32 bytes along the last axis."""
    h = BYTE_HASH[data]
    for level in range(5):
        width = 1 << level
        h = h[..., :-width] * STEP[level] + h[..., width:]
    return mixed(h)


def _sliding(values: np.ndarray, best) -> np.ndarray:
    """``best`` of each OFFSETS neighbouring values."""
    width = 1
    while width * 2 <= OFFSETS:
        values = best(values[:-width], values[width:])
        width *= 2
    rest = OFFSETS - width
    return best(values[:-rest], values[rest:])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts; nulls are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_anchors(data: np.ndarray, offsets: np.ndarray):
    """Row, place in the row, hash of the q-gram and hash of the surroundings of all anchors."""
    found = []
    for begin in range(0, len(data), CHUNK):
        end = min(begin + CHUNK, len(data))
        low, high = max(0, begin - BEFORE), min(len(data), end + LENGTH)
        if high - low < LENGTH:
            continue
        first = np.searchsorted(offsets, low, "right") - 1
        last = np.searchsorted(offsets, high - 1, "right")
        edges = np.clip(offsets[first:last + 1], low, high)
        row = np.repeat(np.arange(first, last), np.diff(edges))
        place = np.arange(low, high)
        room = offsets[row + 1] - place
        gram = gram_hashes(data[low:high])
        value = np.where(room[:len(gram)] >= GRAM, np.minimum(gram, TOP - np.uint64(1)), TOP)
        least = _sliding(value, np.minimum)
        least[room[:len(least)] < LENGTH] = 0
        padded = np.zeros(len(value) + BEFORE, np.uint64)
        padded[BEFORE:BEFORE + len(least)] = least
        chosen = np.flatnonzero((_sliding(padded, np.maximum) == value) & (value != TOP))
        chosen = chosen[(chosen + low >= begin) & (chosen + low < end)]
        before = np.minimum(place[chosen] - offsets[row[chosen]], BEFORE)
        after = np.minimum(room[chosen], LENGTH)
        around = np.zeros(len(chosen), np.uint64)
        whole = (before == BEFORE) & (after == LENGTH)
        at = chosen[whole]
        hashed = np.zeros(len(at), np.uint64)
        for step in (-68, -36, -32, 0, 32, 64, 68):
            hashed = mixed(hashed * STEP[0] + gram[at + step])
        around[whole] = hashed
        for i in np.flatnonzero(~whole):
            a = low + chosen[i]
            text = data[a - before[i]:a + after[i]].tobytes()
            digest = hashlib.blake2b(text, digest_size=8, salt=int(before[i]).to_bytes(2, "little"))
            around[i] = int.from_bytes(digest.digest(), "little")
        found.append((row[chosen], place[chosen] - offsets[row[chosen]], gram[chosen], around))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(part) for part in zip(*found))


def _anchors(batch: pa.RecordBatch):
    """Anchors of a batch in order of bucket, surroundings and place; ``later`` marks all but the first."""
    data, offsets = text_buffer(batch.column("text"))
    keys = batch.column(KEY).to_numpy(zero_copy_only=False)
    row, place, gram, around = find_anchors(data, offsets)
    order = np.lexsort((place, keys[row], around, gram))
    row, place, gram, around = row[order], place[order], gram[order].view(np.int64), around[order].view(np.int64)
    later = np.zeros(len(row), bool)
    later[1:] = (gram[1:] == gram[:-1]) & (around[1:] == around[:-1])
    return data, offsets, keys, row, place, gram, around, later


def _spans(keys, starts, ends) -> pa.RecordBatch:
    """Spans with those of a row merged; a span is one long, start in the upper half."""
    order = np.lexsort((starts, keys))
    keys, starts, ends = keys[order], starts[order], ends[order]
    if len(keys):
        fresh = np.ones(len(keys), bool)
        _, group = np.unique(keys, return_inverse=True)
        shift = group * (int(ends.max()) + 1)
        reach = np.maximum.accumulate(ends + shift) - shift
        fresh[1:] = (keys[1:] != keys[:-1]) | (starts[1:] > reach[:-1])
        at = np.flatnonzero(fresh)
        keys, starts, ends = keys[at], starts[at], reach[np.append(at[1:], len(reach)) - 1]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.astype(np.int64)), pa.array((starts.astype(np.int64) << 32) | ends)], [KEY, "span"])


SPANS = f"{KEY} long, span long"


def _first_anchors(batches):
    for batch in batches:
        _, _, keys, row, place, gram, around, later = _anchors(batch)
        pick = ~later
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram[pick]), pa.array(around[pick]), pa.array(keys[row[pick]].astype(np.int64)),
             pa.array(place[pick].astype(np.int32))], ["gram", "around", KEY, "place"])


def _later_spans(batches):
    """What repeats an anchor of the same batch in full."""
    for batch in batches:
        _, offsets, keys, row, place, _, _, later = _anchors(batch)
        row, place = row[later], place[later]
        size = offsets[row + 1] - offsets[row]
        yield _spans(keys[row], np.maximum(place - BEFORE, 0), np.minimum(place + LENGTH, size))


def _surroundings(known: np.ndarray | None, large: np.ndarray):
    """Bytes around the anchors of the known buckets (of all if None), cut further for large ones."""

    def run(batches):
        for batch in batches:
            data, offsets, keys, row, place, gram, _, later = _anchors(batch)
            pick = ~later
            if known is not None:
                at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                pick &= known[at] == gram if len(known) else False
            out = {name: [] for name in ("bucket", "gram", KEY, "place", "low", "high", "before", "bytes")}
            for i in np.flatnonzero(pick):
                begin, stop = offsets[row[i]], offsets[row[i] + 1]
                a = begin + place[i]
                before = min(int(place[i]), BEFORE)
                text = data[a - before:min(a + LENGTH, stop)].tobytes()
                parts = [(int(gram[i]), 0, BEFORE)]
                if len(large) and large[min(np.searchsorted(large, gram[i]), len(large) - 1)] == gram[i]:
                    parts = _cut(text, before, int(gram[i]))
                for bucket, low, high in parts:
                    for name, value in zip(out, (bucket, int(gram[i]), int(keys[row[i]]), int(place[i]), low, high, before, text)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=AROUND_SCHEMA)

    return run


AROUND_SCHEMA = pa.schema([("bucket", pa.int64()), ("gram", pa.int64()), (KEY, pa.int64()), ("place", pa.int32()),
                           ("low", pa.int32()), ("high", pa.int32()), ("before", pa.int32()), ("bytes", pa.binary())])
AROUND = f"bucket long, gram long, {KEY} long, place int, low int, high int, before int, bytes binary"


def _cut(text: bytes, before: int, gram: int):
    """Sub-buckets of a large bucket: per range of offsets, the bytes all its windows share."""
    for part in range(RANGES):
        low, high = part * OFFSETS // RANGES, (part + 1) * OFFSETS // RANGES - 1
        shared = text[before - low:before + LENGTH - high] if before >= low else b""
        if len(shared) == LENGTH - high + low:
            digest = hashlib.blake2b(shared, digest_size=8, salt=part.to_bytes(2, "little"), person=(gram % 2**64).to_bytes(8, "little"))
            yield int.from_bytes(digest.digest(), "little", signed=True), low, high


def _ranks(values: np.ndarray) -> np.ndarray:
    """Bucket ids per column: equal values get equal ids."""
    order = np.argsort(values, axis=0, kind="stable")
    ordered = np.take_along_axis(values, order, 0)
    steps = np.zeros(values.shape, np.int64)
    steps[1:] = ordered[1:] != ordered[:-1]
    ids = np.empty(values.shape, np.int64)
    np.put_along_axis(ids, order, np.cumsum(steps, axis=0), 0)
    return ids


def refine(before: np.ndarray, texts: list[bytes], low: np.ndarray, high: np.ndarray):
    """First and last offset (bytes from window start to anchor) of the windows that an earlier row
    has too, -1 if none. Rows are in order of place within their bucket."""
    n, width = len(texts), BEFORE + LENGTH
    around = np.zeros((n, width), np.uint8)
    for i, text in enumerate(texts):
        around[i, BEFORE - before[i]:BEFORE - before[i] + len(text)] = np.frombuffer(text, np.uint8)
    after = np.array([len(text) for text in texts], np.int64) - before
    bucket = _ranks(gram_hashes(around))
    bucket = _ranks(bucket[:, :-32] * n + bucket[:, 32:])  # 64 bytes
    window = bucket[:, :OFFSETS] * n + bucket[:, 36:36 + OFFSETS]  # 100 bytes
    offset = BEFORE - np.arange(OFFSETS)
    valid = ((offset <= before[:, None]) & (LENGTH - offset <= after[:, None])
             & (offset >= low[:, None]) & (offset <= high[:, None]))
    window = np.where(valid, window, -1 - np.arange(n)[:, None])
    order = np.argsort(window, axis=0, kind="stable")
    ordered = np.take_along_axis(window, order, 0)
    again = np.zeros(window.shape, bool)
    again[1:] = ordered[1:] == ordered[:-1]
    repeated = np.zeros(window.shape, bool)
    np.put_along_axis(repeated, order, again, 0)
    some = repeated.any(axis=1)
    most = np.where(some, offset[repeated.argmax(axis=1)], -1)
    least = np.where(some, offset[OFFSETS - 1 - repeated[:, ::-1].argmax(axis=1)], -1)
    return least, most


def _refined(batches):
    """Spans of the windows that refinement finds again; rows come in order of bucket and place."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(table: pa.Table):
        column = lambda name: table.column(name).to_numpy()
        place = column("place").astype(np.int64)
        least, most = refine(column("before").astype(np.int64), table.column("bytes").to_pylist(),
                             column("low"), column("high"))
        hit = least >= 0
        return _spans(column(KEY)[hit], (place - most)[hit], (place - least + LENGTH)[hit])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        while size >= ROWS:
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            edge = edge[edge >= ROWS][:1] if (edge >= ROWS).any() else edge[-1:]
            if not len(edge):
                break
            yield work(table.slice(0, edge[0]))
            held = table.slice(edge[0]).combine_chunks().to_batches()
            size = table.num_rows - int(edge[0])
    if size:
        yield work(pa.Table.from_batches(held))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(_key, span) of all bytes to remove; spans of a row may touch and overlap."""
    texts = rows.select(KEY, "text")
    anchors = texts.mapInArrow(_first_anchors, f"gram long, around long, {KEY} long, place int")
    bucket, same = Window.partitionBy("gram"), Window.partitionBy("gram", "around")
    repeated = stage(
        anchors.withColumn("nth", F.row_number().over(same.orderBy(KEY, "place")))
        .withColumn("least", F.min("around").over(bucket)).withColumn("most", F.max("around").over(bucket))
        .filter((F.col("nth") > 1) | (F.col("least") != F.col("most")))
        .select("gram", KEY, "place", (F.col("nth") > 1).alias("later")))
    again = repeated.filter("later").select(KEY, F.shiftleft(F.greatest(F.col("place") - BEFORE, F.lit(0)).cast("long"), 32)
                                            .bitwiseOR((F.col("place") + LENGTH).cast("long")).alias("span"))
    sizes = repeated.filter("not later").groupBy("gram").count()
    n_buckets = sizes.count()
    large = np.sort(np.array([r["gram"] for r in sizes.filter(F.col("count") > SPLIT_BUCKET).collect()], np.int64))
    if n_buckets <= BROADCAST_BUCKETS:
        grams = sizes.select("gram").toPandas()["gram"].to_numpy(np.int64)
        around = texts.mapInArrow(_surroundings(np.sort(grams), large), AROUND)
    else:
        around = texts.mapInArrow(_surroundings(None, large), AROUND).join(
            repeated.filter("not later").select("gram", KEY, "place"), ["gram", KEY, "place"], "left_semi")
    around = around.select("bucket", KEY, "place", "low", "high", "before", "bytes")
    # a number of partitions given by the session: buckets are small or cut before
    refined = around.repartition("bucket").sortWithinPartitions("bucket", KEY, "place").mapInArrow(_refined, SPANS)
    return reduce(DataFrame.unionByName, [texts.mapInArrow(_later_spans, SPANS), again, refined])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = "doc_id long, kept binary"


def _rest(text: bytes, spans: np.ndarray):
    """The kept pieces and the number of removed bytes and runs."""
    starts, ends = spans >> 32, np.minimum(spans & 0xFFFFFFFF, len(text))
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.append(True, starts[1:] > reach[:-1])
    at = np.flatnonzero(fresh)
    starts, ends = starts[at], reach[np.append(at[1:], len(reach)) - 1]
    pieces = [text[a:b] for a, b in zip(np.append(0, ends), np.append(starts, len(text)))]
    return pieces, int((ends - starts).sum()), len(starts)


def _each(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans")):
            text = text.as_py() or b""
            spans = spans.values.to_numpy() if spans.is_valid and len(spans) else None
            yield doc_id, text, *(([text], 0, 0) if spans is None else _rest(text, spans))


def _digests(batches):
    rows = []
    for doc_id, text, pieces, removed, runs in _each(batches):
        digest = hashlib.sha256()
        for piece in pieces:
            digest.update(piece)
        rows.append((doc_id, len(text), removed, runs, digest.hexdigest()))
        if len(rows) == 10_000:
            yield _batch(rows, RESULT)
            rows = []
    yield _batch(rows, RESULT)


def _kept(batches):
    for doc_id, _, pieces, _, _ in _each(batches):
        yield _batch([(doc_id, b"".join(pieces))], KEPT)


TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names = [field.split(" ") for field in fields.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in rows], TYPES[kind]) for i, (_, kind) in enumerate(names)], [name for name, _ in names])


def _with_spans(docs: DataFrame) -> DataFrame:
    rows = keyed(docs, "text")
    spans = repeated_spans(rows).groupBy(KEY).agg(F.collect_list("span").alias("spans"))
    return rows.join(spans, KEY, "left").select("doc_id", "text", "spans")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return _with_spans(docs).mapInArrow(_digests, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the kept bytes, which need not be valid UTF-8."""
    return _with_spans(docs).mapInArrow(_kept, KEPT)
