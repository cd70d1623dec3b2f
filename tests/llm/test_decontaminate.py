"""Decontamination against windows looked up one by one."""

import hashlib
import random
import re

import pytest

from tablekin.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        own = words(text)
        n = min(size, len(own))
        for i in range(len(own) - n + 1) if own else ():
            windows.setdefault(tuple(own[i:i + n]), set()).add(item)
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(window) for window in windows}:
            for i in range(len(own) - n + 1):
                if tuple(own[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(own[i:i + n])]
        names = sorted(str(item) for item in found if item is not None)
        out.append((key, len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(4)
    vocabulary = ["The", "of", "été", "x", "B2", "İ", "and", "data", "ß", "日本"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([0, 2, 7, 10, 15, 30]))) for i in range(25)] + [(7, text(12)), (None, text(11)), (90, None), (91, "...")]
    docs = [(i, ", ".join(draw.choice([text(8), draw.choice(items)[1] or "", (draw.choice(items)[1] or "").upper()])
                          for _ in range(draw.randint(0, 5)))) for i in range(80)]
    return docs + [(200, None), (201, ""), (202, " ,;"), (203, text(6000))], items


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_equals_brute_force(spark, tables, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", block)
    docs, items = tables
    frame = spark.createDataFrame([(k, t, 1, "y") for k, t in docs], "doc_id long, text string, pos int, words string").repartition(3)
    bench = spark.createDataFrame([(k, t, "z") for k, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in dc.report(frame, bench).collect()), key=str)
    assert got == brute(docs, items)
    kept = dc.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in got if not r[5])


def test_repeated_rows_and_empty_tables(spark, tables):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    hit = "zero One, two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, hit), (1, hit), (1, "clean"), (None, hit), (None, "clean")], "doc_id long, text string")
    assert sorted(r["contaminated"] for r in dc.report(docs, bench).collect()) == [False, False, True, True, True]
    assert [r["text"] for r in dc.drop_contaminated(docs, bench).collect()] == ["clean", "clean"]
    assert dc.report(docs.filter("doc_id > 5"), bench).collect() == []
    assert {r["n_items"] for r in dc.report(docs, bench.filter("item_id > 5")).collect()} == {0}


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Say: Alpha, beta - gamma! Then more. "), (2, "alpha beta"), (3, None), (4, "alpha beta gamma")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dc.cut_spans(docs, bench).collect()}
    assert got == {1: "Say: Then more. ", 2: "alpha beta", 3: None, 4: ""}


def test_no_python_in_the_plan(spark, tables, capsys):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string")
    bench = spark.createDataFrame(tables[1], "item_id long, text string")
    dc.report(docs, bench).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)
