"""The pipeline against its stages done one by one in plain Python, and on awkward rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tablekin.llm import near_dedup, secrets, toxicity
from tablekin.llm.decontaminate import WINDOW
from tablekin.llm.near_dedup import words_of

FOLDER = "/root/testdata/sf0.001"


def plain_contaminated(texts, items):
    windows = set()
    for item in items:
        words = words_of(item)
        n = min(WINDOW, len(words))
        windows |= {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()
    lengths = {len(window) for window in windows}
    hit = set()
    for key, text in texts.items():
        words = words_of(text)
        if any(tuple(words[i:i + n]) in windows for n in lengths for i in range(len(words) - n + 1)):
            hit.add(key)
    return hit


def plain_classes(texts):
    """First of each class by k-mers in common order, all pairs."""
    hashes, kept, kmers = near_dedup.WordHashes(), {}, {}
    root = {key: key for key in texts}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    words = {key: words_of(text) for key, text in texts.items()}
    kmers = {key: near_dedup.labelled_kmers(one, hashes) for key, one in words.items()}
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            same = words[a] and words[a] == words[b]
            if find(a) != find(b) and (same or len(kmers[a]) and len(kmers[b]) and near_dedup.aligned(kmers[a], kmers[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    del kept
    return {key for key in keys if find(key) == key}


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    network = toxicity.fit(docs, labels, toxicity.in_training())
    p = toxicity.Scorer(network).probabilities([words_of(text) for text in texts.values()])
    texts = {key: text for (key, text), one in zip(texts.items(), p) if one < 0.5}
    kept = plain_classes(texts)
    texts = {key: text for key, text in texts.items() if key in kept}
    items = [row["text"] for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = plain_contaminated(texts, items)
    texts = {key: text for key, text in texts.items() if key not in bad}
    left = docs.filter(F.col("doc_id").isin(list(texts)))
    clean = {row["doc_id"]: row["text"] for row in secrets.redact(left).collect()}
    for text in clean.values():
        assert not [s for s in secrets.base_spans(text) if s[1] != 0] and text.count("[SECRET]") >= 0
    tokenizer = Tokenizer.from_file(path(pipeline.TOKENIZER))
    expected = {}
    for key, text in clean.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        expected[key] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, FOLDER).collect()}
    assert got == expected and 0 < len(got) < docs.count()


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(None, None, "en", None, None, "a"), (1, "", "en", "s", 0, "b"), (2, long, "en", "s", len(long), "c"),
            (2, long, "en", "s", len(long), "c"), (None, "short text here", None, "s", 15, None), (5, "  \n ", "en", "s", 4, "d")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string")


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_take_awkward_rows(spark, awkward, name):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, awkward, FOLDER)
    assert spark.createDataFrame([], awkward.schema).isEmpty()
    rows = out.collect()
    if name != "bpe":
        assert out.columns == awkward.columns
    assert len(rows) == (5 if name == "near_dedup" else 6)
    assert stage(spark, awkward.filter("doc_id > 99"), FOLDER).collect() == []
    assert Counter(row["doc_id"] for row in rows)[5] == 1
