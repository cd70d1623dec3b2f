"""Records of CSV files cut in parallel, wherever Spark splits the files.

Files are read as lines, block by block. A line that starts outside quotes starts a record, so a task has to know
whether its block does. Of every block of a split file it is found out where either start leads: outside or inside
quotes. These steps are chained over a file's blocks by running sums, and the blocks that start inside quotes are
handed to the tasks. A task cuts all records that lie in its block; pieces of records that reach over a border
meet by the block in which the record starts.

Quotes count where they open a field, and inside such a field until one that is not doubled; elsewhere they are text.
Lines end with LF, CRLF or, outside quotes, CR. Lines of blanks are no records.
"""

import csv
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablekin.functions.frames import cut

RECORDS = ("path string, block long, at long, fields array<string>, piece string, piece_block long, "
           "unreadable boolean, split boolean")
STEPS = "path string, block long, from_outside boolean, from_inside boolean, leaves boolean"
BLANKS = " \t\r"
FLUSH = 4_096

_opening = re.compile('[,\r]"')
_separator = re.compile("[,\r]")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after a line that starts inside or outside of one."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                found = _opening.search(line, at)
                if found is None:
                    return False
                at = found.end() - 1
            at += 1
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at, inside = at + 2, True
            continue
        # what follows a closing quote belongs to the field
        found = _separator.search(line, at + 1)
        if found is None:
            return False
        at, inside = found.end(), False


def split_at_returns(text: str, inside: bool = False) -> list[str]:
    """A text cut at each CR outside quotes; the last part may end inside them."""
    if "\r" not in text:
        return [text]
    out, pending = [], []
    for part in text.split("\r"):
        pending.append(part)
        inside = ends_inside(part, inside)
        if not inside:
            out.append("\r".join(pending))
            pending = []
    return [*out, "\r".join(pending)] if pending else out


def fields_of(texts: list[str]) -> list[list[str]]:
    """The fields of whole records, blank ones left out."""
    csv.field_size_limit(sys.maxsize)
    whole = [record for text in texts for record in split_at_returns(text) if record.strip(BLANKS)]
    return list(csv.reader(whole))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path, block, split`` (the file has several blocks) and ``line``, null where it is not UTF-8."""
    whole = F.col("_metadata.file_block_length") == F.col("_metadata.file_size")
    return spark.read.option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        (~whole).alias("split"), F.when(F.is_valid_utf8("value"), F.col("value")).alias("line"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list[str | None]]]:
    """The lines of each batch by block, in their order."""
    for batch in batches:
        paths = batch.column("path").dictionary_encode()
        codes, names = paths.indices.to_numpy(), paths.dictionary.to_pylist()
        starts = batch.column("block").to_numpy()
        borders = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        lines = batch.column("line")
        for low, high in zip([0, *borders], [*borders, len(codes)], strict=True):
            if low < high:
                yield (names[codes[low]], int(starts[low]), batch.column("split")[int(low)].as_py(),
                       lines.slice(low, high - low).to_pylist())


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each block leads from outside and from inside quotes, and whether the second is left in between."""
    made, key, state = [], None, (False, True, False)
    for path, block, _, lines in _blocks(batches):
        if key != (path, block):
            if key:
                made.append((*key, *state))
            key, state = (path, block), (False, True, False)
        outside, inside, leaves = state
        for line in lines:
            if line is not None:
                leaves |= inside and len(split_at_returns(line, True)) > 1
                outside, inside = ends_inside(line, outside), ends_inside(line, inside)
                leaves |= not inside
        state = outside, inside, leaves
    if key:
        made.append((*key, *state))
    columns = list(zip(*made, strict=True)) or [[]] * 5
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(list(values), kind) for values, kind in zip(columns, types, strict=True)],
                                     ["path", "block", "from_outside", "from_inside", "leaves"])


def chained(steps: DataFrame) -> DataFrame:
    """``path, block, starts_inside, ends_inside, owner`` of each block that has quotes; a file starts outside.

    ``owner`` is the block in which the record starts that is open. Blocks without quotes change nothing.
    """
    order = Window.partitionBy("path").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    odd = F.col("from_outside") & ~F.col("from_inside")
    turned = steps.withColumn("turns", F.sum(F.when(odd, 1).otherwise(0)).over(upto) % 2 == 1)
    # a block that leads to one end from either start fixes the state; later blocks may only turn it
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside") != F.col("turns"))
    known = turned.withColumn("ends_inside", F.coalesce(
        F.last(fixed, ignorenulls=True).over(upto), F.lit(False)) != F.col("turns"))
    known = known.withColumn("starts_inside", F.coalesce(F.lag("ends_inside").over(order), F.lit(False)))
    opens = F.col("ends_inside") & (~F.col("starts_inside") | F.col("leaves"))
    owner = F.when(F.col("ends_inside"), F.last(F.when(opens, F.col("block")), ignorenulls=True).over(upto))
    return known.select("path", "block", "starts_inside", "ends_inside", owner.alias("owner"))


class _Block:
    """Cuts the lines of one block into records and pieces."""

    def __init__(self, path: str, block: int, split: bool, owner: int | None):
        self.path, self.block, self.split = path, block, split
        self.owner = owner  # of the record that is open at the start
        self.head: list[str] | None = None if owner is None else []
        self.texts: list[str] = []
        self.open: list[str] = []
        self.at = 0
        self.first = True

    def add(self, lines: list[str | None]) -> Iterator[tuple]:
        for line in lines:
            if line is None:
                yield self.row(unreadable=True)
                continue
            if self.first:
                self.first = False
                if self.block == 0:
                    line = line.removeprefix("﻿")
            if self.head is not None:
                part, *rest = split_at_returns(line, True)
                self.head.append(part)
                if rest or not ends_inside(part, True):
                    yield self.row(block=self.owner, piece="\n".join(self.head), piece_block=self.block)
                    self.head = None
                    # the last of the records that follow a CR may be open
                    if rest and ends_inside(rest[-1], False):
                        self.open = [rest.pop()]
                    self.texts += rest
            elif self.open or '"' in line:
                inside = ends_inside(line, bool(self.open))
                self.open.append(line)
                if not inside:
                    self.texts.append("\n".join(self.open))
                    self.open = []
            else:
                self.texts.append(line)
            if len(self.texts) >= FLUSH:
                yield from self.cut()
        yield from self.cut()

    def cut(self) -> Iterator[tuple]:
        for fields in fields_of(self.texts):
            yield self.row(at=self.at, fields=fields)
            self.at += 1
        self.texts = []

    def end(self) -> Iterator[tuple]:
        if self.head is not None:
            yield self.row(block=self.owner, piece="\n".join(self.head), piece_block=self.block)
        elif self.open and not self.split:
            yield self.row(unreadable=True)
        elif self.open:
            # records that a CR ends are whole, however the line goes on
            *whole, last = split_at_returns("\n".join(self.open))
            self.texts += whole
            yield from self.cut()
            yield self.row(at=self.at, piece=last, piece_block=self.block)

    def row(self, block=None, at=None, fields=None, piece=None, piece_block=None, unreadable=False) -> tuple:
        return (self.path, self.block if block is None else block, at, fields, piece, piece_block, unreadable, self.split)


def _records(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(values), kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows: list[tuple] = []
    current: _Block | None = None
    for path, block, split, lines in _blocks(batches):
        if current is None or (current.path, current.block) != (path, block):
            if current:
                rows += current.end()
            current = _Block(path, block, split, _owner(shared.value, path, block) if split else None)
        for row in current.add(lines):
            rows.append(row)
            if len(rows) >= FLUSH:
                yield batch(rows)
                rows = []
    if current:
        rows += current.end()
    if rows:
        yield batch(rows)


def _owner(known: dict, path: str, block: int) -> int | None:
    """The block whose record is open where a block starts."""
    blocks, owners = known.get(path, ((), ()))
    at = bisect_left(blocks, block) - 1
    return owners[at] if at >= 0 else None


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of records that were put together from pieces."""
    for batch in batches:
        fields = [(fields_of([text]) or [None])[0] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name) for name in ("path", "block", "at")), pa.array(fields, pa.list_(pa.string()))],
            ["path", "block", "at", "fields"])


def read_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The records of all ``*.csv`` of a folder, and the paths of unreadable ones.

    Records are ``path, block, at, fields, split``, in the order of (block, at) in their file. Unreadable is a file that is
    not UTF-8 or ends inside quotes; some of its records may be there. Files are parsed once, the records are kept in the checkpoint
    folder. What the driver sees of them is a row per block that starts or ends inside quotes.
    """
    lines = read_lines(spark, folder)
    quoted = lines.filter(F.col("split") & F.contains("line", F.lit('"')))
    after = cut(chained(quoted.mapInArrow(_steps, STEPS)))
    known: dict[str, tuple[list, list]] = {}
    for row in after.filter("starts_inside or ends_inside").orderBy("path", "block").collect():
        blocks, owners = known.setdefault(row["path"], ([], []))
        blocks.append(row["block"])
        owners.append(row["owner"])
    parsed = cut(lines.mapInArrow(partial(_records, shared=spark.sparkContext.broadcast(known)), RECORDS))
    unclosed = after.groupBy("path").agg(F.max_by("ends_inside", "block").alias("open")).filter("open").select("path")
    unreadable = parsed.filter("unreadable").select("path").union(unclosed).distinct()
    whole = parsed.filter(F.col("fields").isNotNull()).select("path", "block", "at", "fields", "split")
    if not known:
        return whole, unreadable
    pieces = parsed.filter(F.col("piece").isNotNull()).join(unclosed, "path", "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_block", "piece"))), lambda p: p["piece"]), "\n")
    over = pieces.groupBy("path", "block").agg(F.max("at").alias("at"), text.alias("text")).mapInArrow(
        _joined, "path string, block long, at long, fields array<string>").filter(F.col("fields").isNotNull())
    return whole.unionByName(over.withColumn("split", F.lit(True))), unreadable
