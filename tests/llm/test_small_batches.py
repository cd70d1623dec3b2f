"""Stages of the pipeline pass texts to Python in small batches and keep to themselves what they set."""

import pytest
from pyspark.sql import functions as F

from tablekin.llm import common, near_dedup, secrets, toxicity

BOUND, ROWS = 1 << 16, 2000


@pytest.fixture
def docs(spark):
    return spark.range(0, ROWS, 1, 1).select(
        F.col("id").alias("doc_id"), F.format_string("some words %d %s", "id", F.repeat(F.lit("and more "), 100)).alias("text"),
        F.lit(None).alias("nothing"), F.lit("x").alias("_clean"))


@pytest.fixture
def watched(spark, monkeypatch):
    """Batches that are larger than asked for fail the stage."""
    setting = spark.conf.get(common.BATCH_SETTING)
    monkeypatch.setattr(common, "BATCH_BYTES", BOUND)

    def released(work):
        def run(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 4 * BOUND
                    yield batch

            yield from work(small())

        return common.released(run)

    for module in (near_dedup, secrets, toxicity):
        monkeypatch.setattr(module, "released", released)
    yield
    assert spark.conf.get(common.BATCH_SETTING) == setting


def test_toxic_documents_are_found_in_small_batches(watched, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda *args: None)  # without a network no text is toxic
    assert toxicity.drop_toxic(docs.drop("nothing"), None).count() == ROWS


def test_near_copies_are_found_in_small_batches(watched, docs):
    plain = docs.drop("nothing")
    copies = plain.unionByName(plain.limit(5).withColumn("doc_id", F.col("doc_id") + ROWS))
    assert {r["doc_id"] for r in near_dedup.drop_near_copies(copies).select("doc_id").collect()} <= set(range(ROWS))


def test_redaction_in_small_batches_keeps_all_columns(watched, docs, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE_SNIPPETS", 5)
    rows = docs.withColumn("text", F.when(F.col("doc_id") > 0, F.concat("text", F.lit('token = "abcdef123"'))))
    out = secrets.redact(rows)
    assert out.columns == rows.columns and dict(out.dtypes)["nothing"] == "void"
    made = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(made) == ROWS and made[0] is None
    assert all(made[i].endswith('token = "[SECRET]"') for i in range(1, ROWS))
