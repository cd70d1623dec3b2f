"""Licences named after one another, every window against every notice, and very long texts."""

import pytest

from tablekin.llm import licenses as li
from tablekin.llm.near_dedup import words_of

GNU = "it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or"
CASES = [
    (GNU.format("Affero ", ",", "3"), "AGPL"), (GNU.format("Lesser ", ";", "2.1"), "LGPL"), (GNU.format("Lesser ", ",", "3"), "LGPL"),
    (GNU.format("Library ", ";", "2"), "LGPL"), (GNU.format("", ";", "2"), "GPL"), (GNU.format("", ",", "3"), "GPL"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License.", "CC-BY-ND"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.", "CC-BY-NC"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY"),
    ("SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC"), ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided", "ISC"),
    ("are made available under the terms of the Eclipse Public License 2.0 which is available at", "EPL")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(docs)


def families(found):
    return {family for (_, _, family), sure in found if sure}


@pytest.mark.parametrize("said, family", CASES)
def test_one_notice_has_one_family(model, said, family):
    words = said.split(" ")
    wrapped = "\n".join(" * " + " ".join(words[i:i + 7]) for i in range(0, len(words), 7))
    for text in (said, wrapped if len(words) > 7 else said, "word " * 30 + said + " word" * 50):
        (_, found), = li.scan([f"first\n\n{text}\n\nlast"], model, li.WordIds())
        assert families(found) == {family}


def test_two_licences_in_one_line_are_both_named(model):
    (_, found), = li.scan(["Released under the MIT License. Licensed under the Apache License, Version 2.0"], model, li.WordIds())
    assert families(found) == {"MIT", "Apache"}


def test_every_window_against_every_notice(model, docs):
    """The classifier passes over no line that a notice, compared by itself, confirms, and adds none."""
    texts = [row["text"] for row in docs.select("text").collect()]
    for text, (_, found) in zip(texts, li.scan(texts, model, li.WordIds())):
        expected, start = set(), 0
        for line in text.split("\n"):
            words = words_of(line)
            for a, b in li.units(len(words)):
                own = list(zip(words[a:b], words[a + 1:b], words[a + 2:b]))
                shares = {}
                for family, triples in li.TEMPLATES:
                    common = set(own) & triples
                    if len(common) >= li.CONFIRMED * len(triples):
                        shares[family] = max(shares.get(family, 0), len(common))
                # the test data have one licence a line: the notice that explains most
                most = max(shares.values(), default=0)
                if list(shares.values()).count(most) == 1:
                    expected |= {(start, start + len(line), family) for family, n in shares.items() if n == most}
            start += len(line) + 1
        assert {key for key, sure in found if sure and "\n" not in text[key[0]:key[1]]} == expected


def test_a_very_long_text_is_scored_group_by_group(model, monkeypatch):
    sizes = []
    plain = li.feature_rows
    monkeypatch.setattr(li, "feature_rows", lambda words, ids: sizes.append(len(words)) or plain(words, ids))
    notice = "Released under the MIT License."
    text = "some words\n" * 30_000 + notice + "\n\n" + "word " * 200_000
    (n, found), = li.scan([text], model, li.WordIds())
    assert n == 30_002 and families(found) == {"MIT"} and max(sizes) <= li.GROUP
