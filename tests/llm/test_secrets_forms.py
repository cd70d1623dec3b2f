"""Secrets of forms that training does not make, whole values, and harmless things that look alike."""

import random

import pytest

from tablekin.llm import secrets as sc

LETTERS_DIGITS = sc.ALPHABETS[2]


def _some(draw, alphabet, n):
    return "".join(draw.choice(alphabet) for _ in range(n))


# what stands before the value, and the value
UNSEEN = {
    "cloud key": lambda d: ("AWS_SECRET_ACCESS_KEY=", _some(d, LETTERS_DIGITS + "/+", 40)),
    "sk": lambda d: ("", "sk-" + _some(d, LETTERS_DIGITS, 48)),
    "ghp": lambda d: ("", "ghp_" + _some(d, LETTERS_DIGITS, 36)),
    "xoxb": lambda d: ("", f"xoxb-{_some(d, '0123456789', 12)}-{_some(d, '0123456789', 12)}-{_some(d, LETTERS_DIGITS, 24)}"),
    "bearer": lambda d: ("Bearer ", f"eyJhbGciOiJIUzI1NiJ9.{_some(d, LETTERS_DIGITS, 60)}.{_some(d, LETTERS_DIGITS + '-_', 43)}"),
    "url": lambda d: ("postgres://admin:", _some(d, LETTERS_DIGITS, 12) + "@db.example.org"),
    "short": lambda d: ("pwd: ", _some(d, LETTERS_DIGITS, 7) + _some(d, "0123456789", 2)),
    "license": lambda d: ("license_code : ", _some(d, sc.ALPHABETS[3], 24)),
}


def _covered(field, made, n=100):
    """How many of n secrets are covered whole; ``made`` gives text, start and end."""
    draw, shapes, found = random.Random(5), sc.Shapes(field), 0
    for _ in range(n):
        said, a, b = made(draw)
        text = f"On this machine we use {said} and then more"
        a, b = a + 23, b + 23
        spans = [sc._value(text, *span) for span in sc.all_spans(text, field, shapes)]
        found += set(range(a, b)) <= {at for x, y in spans for at in range(x, y)}
    return found


@pytest.fixture(scope="module")
def field(spark):
    return sc.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("name", UNSEEN)
def test_unseen_secrets_are_covered_whole(field, name):
    def made(draw):
        before, value = UNSEEN[name](draw)
        return before + value, len(before), len(before) + len(value.split("@")[0])

    assert _covered(field, made) >= 85


@pytest.mark.parametrize(("form", "least"), [("signed", 80), ("prefixed", 50), ("dotted", 80), ("plain", 50)])
def test_forms_left_out_of_training(monkeypatch, form, least):
    made = sc.FORMS[form]
    monkeypatch.delitem(sc.FORMS, form)
    assert _covered(sc.train(sc._fixed_examples()), made) >= least


def test_harmless_things_are_left_alone(field):
    draw, shapes = random.Random(77), sc.Shapes(field)
    wrong = [text for text in (f"we see {sc._harmless(draw)} in it" for _ in range(500))
             if any(kind == 3 for _, kind, _ in sc.all_spans(text, field, shapes))]
    assert len(wrong) <= 5


@pytest.mark.parametrize(("text", "spans", "expected"), [
    ("x ab-cd.ef y", [(5, 7)], ["ab-cd.ef"]), ("k=ab+/cd== y", [(2, 4)], ["ab+/cd=="]), ("say abcd. Then", [(4, 8)], ["abcd"]),
    ("u://me:pw1@h/", [(7, 10)], ["pw1"]), ("at /usr/lib/x1 y", [(12, 14)], ["x1"]), ("ab-cd ef", [(0, 2), (3, 5), (6, 8)], ["ab-cd", "ef"]),
    ("ab-cd-ef", [(0, 2), (6, 8)], ["ab-cd-ef"]), ("abc", [(0, 3)], ["abc"]), ("x.", [(0, 2)], ["x."]), ("", [], []),
])
def test_whole_values(text, spans, expected):
    assert [text[a:b] for a, b in sc.whole_values(text, spans)] == expected


def test_long_runs_take_time_in_proportion():
    text = "ab-" * 400_000
    assert sc.whole_values(text, [(at, at + 2) for at in range(0, len(text), 3)]) == [(0, len(text) - 1)]


def test_what_a_pattern_leaves_is_added(monkeypatch):
    hexed = "0123456789abcdef01234567"
    text = f"it is xo-{hexed}-Zz and token={hexed} too"
    start, inner = text.index("xo-"), text.index("token=") + 6
    monkeypatch.setattr(sc, "field_spans", lambda *_: [(start, start + 2), (inner, inner + 24)])
    spans = sc.all_spans(text, None, None)
    assert [s for s in spans if s[1] < 3] == sc.base_spans(text)
    assert [text[a:b] for a, k, b in spans if k == 3] == [f"xo-{hexed}-Zz"]
