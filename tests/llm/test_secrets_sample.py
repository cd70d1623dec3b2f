"""The training sample takes a text once, however many copies it has."""

from tablekin.llm import secrets as sc


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(sc, "train", taken.extend)
    monkeypatch.setattr(sc, "SAMPLE_SNIPPETS", 12)
    said = [f"some words before api_key = 'Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1J{i}' and after" for i in range(6)]
    for many in said:
        texts = said + [many] * 40
        taken.clear()
        sc.fit(spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id long, text string"))
        sampled = taken[:-len(sc._fixed_examples())]
        assert len(sampled) == len({(at, text) for at, text, _, _ in sampled}) == 12
