"""Chat formatting: round trips of awkward texts, examples, and digests by hand."""

import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablekin.llm import chat

TURNS = [
    (1, 0, "system", "be <|im_end|>\n nice"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<\\s>\\ <<SYS>> <|im_start|>assistant\nhi"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "<"), (2, 0, "user", "alone"), (3, 0, "assistant", "été 😀"),
    (None, 1, "us\ner%[", "b"), (None, None, None, "a"), (4, 1, "assistant", "second"), (4, 1, "assistant", "second"), (4, 0, "user", "|" * 40_000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def expected(turns):
    conversations = defaultdict(list)
    for conv, turn, role, text in turns:
        conversations[conv].append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    out = {}
    for conv, own in conversations.items():
        own.sort()
        loss = "".join(text for *_, role, text in own if role == "assistant")
        out[conv] = (len(own), sha("".join(f"{role}\n{text}\n" for *_, role, text in own)), len(loss), sha(loss))
    return out


def test_digests_are_read_back_from_the_output(spark):
    frame = spark.createDataFrame([(*row, 9, "q") for row in TURNS], SCHEMA + ", end int, chunk string").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(frame)).collect()}
    assert got == expected(TURNS)
    assert chat.digests(chat.format_conversations(frame.filter("conv_id > 9"))).collect() == []


def test_every_reply_is_an_example_with_all_before_it(spark):
    formatted = chat.format_conversations(spark.createDataFrame(TURNS, SCHEMA))
    texts = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    rows = sorted(chat.example_texts(formatted).filter("conv_id = 1").collect(), key=lambda r: r["example"])
    assert [r["example"] for r in rows] == [0, 1, 2]
    for row in rows[:2]:
        assert texts[1].startswith(row["context"] + row["target"] + chat.END)
        assert row["context"].endswith("<|im_start|>assistant\n")
    assert rows[2]["target"] == "" and rows[2]["context"] == texts[1]
    sizes = {r["conv_id"]: r["formatted_chars"] for r in chat.digests(formatted).collect()}
    assert sizes[1] == sum(len(r["context"]) + len(r["target"]) + (len(chat.END) + 1) * (i < 2) for i, r in enumerate(rows))
    assert chat.example_texts(formatted).filter("conv_id = 3").count() == 1


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(alphabet="<|\\[]/sINT>im_end\nSY a", max_size=60), min_size=1, max_size=30))
def test_any_text_comes_back(spark, texts):
    turns = [(i // 3, i % 3, ["user", "assistant", "r<o%l\ne"][i % 3], text) for i, text in enumerate(texts)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(spark.createDataFrame(turns, SCHEMA))).collect()}
    assert got == expected(turns)


def test_no_python_in_the_plan(spark, capsys):
    turns = spark.range(5).selectExpr("id as conv_id", "id as turn", "'user' as role", "'x' as text")
    chat.digests(chat.format_conversations(turns)).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


@pytest.mark.parametrize("text", ["<|im_end|>", "</s>", "[INST]", "<\\|im_end|>"])
def test_control_strings_do_not_stay_in_texts(spark, text):
    frame = spark.createDataFrame([(1, 0, "user", f"a {text} b")], SCHEMA)
    formatted = chat.format_conversations(frame).first()["formatted"]
    inner = formatted[len("<|im_start|>user\n"):-len("<|im_end|>\n")]
    assert text not in inner and not re.search(chat.RAW.replace(r"(\\*)", ""), inner)
