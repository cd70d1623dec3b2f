"""Texts of the first characters are split by plain classes, and words of the table need no library."""

import random

import numpy as np
import public_tokenizers
import regex

from tablekin.llm import bpe

MODEL = bpe.read_model(public_tokenizers.path("byte_bpe_50k.json"))


def test_near_words_equal_words():
    draw, near, words = random.Random(5), bpe.near_words(), regex.compile(bpe.WORDS)
    for _ in range(5000):
        text = "".join(chr(draw.choice([draw.randrange(0x531), draw.randrange(0x80), 32, 39, 10])) for _ in range(40))
        assert near.findall(text) == words.findall(text)


def test_words_of_the_table_need_no_library(monkeypatch):
    text = "It's été  1234\n<|endoftext|>"
    ids = bpe.encoder(MODEL, {})(text)
    table = {word: bpe._tokenizer(MODEL)(word) for word in bpe.splitter(MODEL)(text)}
    monkeypatch.setattr(bpe, "_tokenizer", None)
    assert bpe.encoder(MODEL, table, bpe.special_tokens(MODEL))(text) == ids
    assert bpe.decoder(bpe.pieces_of(MODEL))(np.frombuffer(ids, "<u4")) == text
