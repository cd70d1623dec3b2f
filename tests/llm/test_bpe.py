"""Encoding and decoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer, pre_tokenizers

from tablekin.llm import bpe, common

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    wild = ["".join(chr(draw.choice([draw.randrange(0x80), draw.randrange(0x500), draw.randrange(0x3000), draw.randrange(0xE000, 0x20000)]))
                    for _ in range(60)) for _ in range(100)]
    plain = ["It's  a\n\n test,\tisn't  it?   ", "été à l'œuvre  1234 ½", "a<|endoftext|> b  <|endoftext|><|endoftext|>", "<|endoftext",
             "", None, "   ", "word " * 3000, "日本語 テスト — “quoted”", "don’t 'll'd'S"]
    return plain + wild + plain[:3]


def expected(text):
    tokenizer = Tokenizer.from_file(PATH)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@pytest.mark.parametrize("bound", [0, 20, 1 << 18])
def test_equals_the_library(spark, texts, monkeypatch, bound):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 50)
    frame = spark.createDataFrame([(i, t, "en", t) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n string")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.report(frame, PATH, bound).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_round_trip_and_clashing_names(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = bpe.encode(frame, PATH)
    assert encoded.columns == ["doc_id", "text", "ids", "ids_"]
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH, "ids_").collect()}
    assert decoded == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(frame.filter("doc_id < 0"), PATH).collect() == []


def test_settled_characters_split_alike():
    unsettled, words = regex.compile(bpe.SETTLED), regex.compile(bpe.WORDS)
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for code in [*range(0x540), *range(0x2000, 0x2080), *range(0x3000, 0x3100), *range(0x4E00, 0xD800)]:
        text = f"a{chr(code)}1{chr(code)} "
        if not unsettled.search(text):
            assert [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)] == words.findall(text), hex(code)


def test_texts_come_in_small_batches(spark, monkeypatch):
    bound, setting = 1 << 16, spark.conf.get(common.BATCH_SETTING)
    monkeypatch.setattr(common, "BATCH_BYTES", bound)

    def watched(work):
        def run(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 4 * bound
                    yield batch

            yield from work(small())

        return common.released(run)

    monkeypatch.setattr(bpe, "released", watched)
    frame = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 100) as text")
    assert {tuple(r)[1:] for r in bpe.report(frame, PATH).collect()} == {expected("some words " * 100)}
    assert spark.conf.get(common.BATCH_SETTING) == setting
