"""Notices that stand over several lines, as headers of source files have them."""

import pytest

from tablekin.llm import licenses as li

CASES = {
    "GPL": ["you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
            "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions",
            "are met:"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining", "a copy of this software and associated documentation files",
            "(the \"Software\"), to deal in the Software without restriction"],
    "Apache": ["you may not use this file except in", "compliance with the License. You may obtain a copy", "of the License at",
               "http://www.apache.org/licenses/LICENSE-2.0"],
}


@pytest.fixture(scope="module")
def model(spark):
    return li.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("family", CASES)
def test_wrapped_headers(model, family, mark):
    lines = CASES[family]
    text = "ñ é first\n\n" + "\n".join(mark + line for line in lines) + "\n\nother words"
    (n, found), = li.scan([text], model, li.WordIds())
    assert n == len(lines) + 2
    spans = [text[a:b] for (a, b, f), sure in found if sure and f == family]
    assert any(said.count("\n") for said in spans)
    assert all("other" not in said and "first" not in said for said in spans)


def test_blank_lines_part_and_single_lines_stay_single(model):
    lines = CASES["BSD"]
    (_, found), = li.scan(["\n\n".join(lines[0].rsplit(" ", 6))], model, li.WordIds())
    assert not any(sure for _, sure in found)
    notice = "Released under the MIT License."
    (_, found), = li.scan([f"{notice}\n{notice}\nother"], model, li.WordIds())
    assert [key for key, sure in found if sure] == [(0, 31, "MIT"), (32, 63, "MIT")]
