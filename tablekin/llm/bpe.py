"""Byte-level BPE encoding through a table of distinct words, and decoding through a table of pieces.

Spark counts the distinct words of all texts. The most frequent ones (all of them if they fit the bound) are
encoded once each, in Spark, and the word table is broadcast: every text is split again, its words
are looked up and their ids joined in order of position. A word outside the bounded table is encoded where it
stands, each word once per task as long as a bounded memory of them lasts. Decoding looks up the
bytes of each id in the vocabulary, whose size the tokenizer file fixes. Whole texts come to Python in small batches.

Results equal those of the tokenizers library with the same file, special tokens in a text
included. Null texts are empty and have no ids; empty tables, repeated rows and other columns make
no difference.
"""

import hashlib
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import give_back, released, shipped, small_batches, stage

shipped(__name__)

TABLE_WORDS = 1 << 18  # words in the broadcast table, some 20 bytes each
MEMORY_WORDS = 1 << 17  # other words a task remembers
COUNTED_WORDS = 1 << 18  # distinct words a task counts before it passes them on
SENT_WORDS = 1 << 15  # of them that are passed on at once
# fixed value: how the byte-level tokenizer splits texts
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# characters of which all Unicode versions think alike; texts with others are split by the library
SETTLED = r"[^\x00-԰ -⁰ぁ-ゖァ-ヺ一-龥가-힣]"

NEAR_END = "\u0530"  # the end of the first settled range


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in own]
    return {chr(byte): byte for byte in own} | {chr(256 + i): byte for i, byte in enumerate(others)}


def pieces_of(model: str) -> list[bytes]:
    """The bytes of each id."""
    content = json.loads(model)
    stand_in = byte_characters()
    pieces = dict.fromkeys(range(max([*content["model"]["vocab"].values(), *[t["id"] for t in content["added_tokens"]]]) + 1), b"")
    for piece, number in content["model"]["vocab"].items():
        pieces[number] = bytes(stand_in[c] for c in piece)
    for token in content["added_tokens"]:
        pieces[token["id"]] = token["content"].encode()
    return [pieces[i] for i in range(len(pieces))]


def special_tokens(model: str) -> list[str]:
    """The texts of the tokens that are never split."""
    return [token["content"] for token in json.loads(model)["added_tokens"]]


def near_words() -> re.Pattern:
    """WORDS for texts of the first characters only, of which ``re`` finds the words faster with classes spelled out."""
    near = [chr(code) for code in range(ord(NEAR_END) + 1)]
    space, letter, number = ("".join(re.escape(c) for c in near if kind.fullmatch(c))
                             for kind in map(regex.compile, (r"\s", r"\p{L}", r"\p{N}")))
    return re.compile(WORDS.replace(r"\S", f"[^{space}]").replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(
        r"\s", f"[{space}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]"))


def splitter(model: str, special: list[str] | None = None):
    """A function from a text to (words, special) parts, as the library would split it; ``special`` tokens if known."""
    from tokenizers import pre_tokenizers

    special = set(special_tokens(model) if special is None else special)
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    words, unsettled = regex.compile(WORDS), regex.compile(SETTLED)
    near, far = near_words(), re.compile(f"[^\0-{NEAR_END}]")
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def plain(text: str) -> list[str]:
        if text.isascii() or not far.search(text):
            return near.findall(text)
        if not unsettled.search(text):
            return words.findall(text)
        return [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]

    def split(text: str) -> list[str]:
        if cut is None or not any(token in text for token in special):
            return plain(text)
        return [word for part in cut.split(text) for word in ([part] if part in special else plain(part))]

    return split


def _tokenizer(model: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    give_back()  # parsing the file takes more than what is kept of it
    return lambda word: np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(model: str, table: dict[str, bytes], special: list[str] | None = None):
    """A function from a text to its ids as little-endian bytes; the library is loaded when a word is not in the table."""
    split, encode = splitter(model, special), None
    memory: dict[str, bytes] = {}

    def rare(word: str) -> bytes:
        nonlocal encode
        encode = encode or _tokenizer(model)
        known = memory.get(word)
        if known is None:
            if len(memory) >= MEMORY_WORDS:
                memory.clear()
            known = memory[word] = encode(word)
        return known

    def ids(text: str) -> bytes:
        words = split(text)
        made = list(map(table.get, words))
        at = -1
        for _ in range(made.count(None)):
            at = made.index(None, at + 1)
            made[at] = rare(words[at])
        return b"".join(made)

    return ids


def decoder(pieces: list[bytes]):
    """A function from ids to the text; bytes that are no UTF-8 become replacement characters."""
    return lambda ids: b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def word_counts(docs: DataFrame, model: str) -> DataFrame:
    """(word, n) of all distinct words; tasks count before words are shuffled."""
    special = special_tokens(model)

    def count(batches):
        split = splitter(model, special)
        words: Counter[str] = Counter()

        def counted():
            return pa.Table.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"]).to_batches(SENT_WORDS)

        for batch in batches:
            for text in batch.column("text"):
                words.update(split(text.as_py() or ""))
                if len(words) > COUNTED_WORDS:
                    yield from counted()
                    words.clear()
        yield from counted()

    return docs.select("text").mapInArrow(released(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, model: str, bound: int = TABLE_WORDS) -> pa.Table:
    """``word, ids`` of the most frequent words, at most ``bound``; words of one frequency class go together."""
    with small_batches(docs.sparkSession):
        counts = stage(word_counts(docs, model))
    level = F.floor(F.log2("n") * 32)
    classes = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in classes:
        total += row["count"]
        if total > bound:
            break
        least = row["level"]
    if least is None:
        return pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.binary())})

    def encode(batches):
        ids = _tokenizer(model)
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array(map(ids, words.to_pylist()), pa.binary())], ["word", "ids"])

    return counts.filter(level >= least).select("word").mapInArrow(released(encode), "word string, ids binary").toArrow()


def by_word(table: pa.Table) -> dict[str, bytes]:
    """The word table as a task looks words up; a task's own, so that it goes with the task."""
    return dict(zip(table.column("word").to_pylist(), table.column("ids").to_pylist()))


def read_model(path: str) -> str:
    """The tokenizer file, read on the driver; a local path."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str, bound: int = TABLE_WORDS) -> DataFrame:
    """All columns of the documents and ``ids``, the token ids of the text."""
    model = read_model(path)
    table, special = docs.sparkSession.sparkContext.broadcast(word_table(docs, model, bound)), special_tokens(model)
    name = "ids"
    while name in docs.columns:
        name += "_"

    def run(batches):
        ids = encoder(model, by_word(table.value), special)
        for batch in batches:
            made = [np.frombuffer(ids(text.as_py() or ""), "<i4") for text in batch.column("text")]
            offsets = np.append(0, np.cumsum([len(one) for one in made])).astype(np.int32)
            values = np.concatenate(made) if made else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))], [*batch.schema.names, name])

    schema = docs.select("*", F.lit(None).cast("array<int>").alias(name)).schema
    return docs.mapInArrow(released(run), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and the text of the ids; null ids give an empty text."""
    pieces = pieces_of(read_model(path))

    def run(batches):
        text = decoder(pieces)
        for batch in batches:
            made = [text(one.values.to_numpy()) if one.is_valid else "" for one in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(released(run), "doc_id long, text string")


def report(docs: DataFrame, path: str, bound: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded in one pass.

    The rows are small and kept as a stage, so that no reader's settings decide how much text a task holds.
    """
    model = read_model(path)
    table = docs.sparkSession.sparkContext.broadcast(word_table(docs, model, bound))
    special, pieces = special_tokens(model), pieces_of(model)

    def run(batches):
        ids, text = encoder(model, by_word(table.value), special), decoder(pieces)
        for batch in batches:
            sizes, hashes, read = [], [], []
            for one in batch.column("text"):
                made = ids(one.as_py() or "")
                sizes.append(len(made) // 4)
                hashes.append(hashlib.sha256(made).hexdigest())
                read.append(hashlib.sha256(text(np.frombuffer(made, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(read, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    with small_batches(docs.sparkSession):
        return stage(made)
