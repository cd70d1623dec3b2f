"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line with words; longer ones are read in windows of 40 words, 20 apart. Notices wrapped over
lines are read in such windows over all lines up to one without words (comment marks are none); what they
confirm counts once, from its first line to its last, in place of what its lines leave unconfirmed. A sparse
logistic regression over words and word pairs gives each window a licence family or "unknown". It is trained
in numpy on variants of licence notices (cut, with dropped words, inside other text) against
lines of a bounded sample of the documents and near misses; its probabilities are calibrated on examples kept
back. Where notices are likelier than not, every family of some probability counts once a template confirms it: most of
a notice's word triples must stand in the window, more than of any notice of another family at that place, and a word that tells the
family from those it is named after (Affero, Lesser, NoDerivatives). So one notice has one family. A paragraph
that confirms no family is left unconfirmed, under the likeliest one.

Null and empty texts have no paragraphs. Repeated rows are scanned one by one; without documents
the near misses are the only other text. Other columns are ignored.
"""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekin.llm.common import by_value, opened, released, shipped
from tablekin.llm.near_dedup import words_of

shipped(__name__)

# fixed values: how works say what licence they are under, by family
NOTICES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "Licensed under the BSD 3-Clause License", "Released under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0", "Released under CC BY-NC-SA 4.0 for noncommercial use only", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0", "Text is available under the Creative Commons Attribution-ShareAlike License",
        "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3", "Licensed under the GNU AGPL version 3 or later",
        "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU GPL version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "Licensed under the GNU LGPL version 3 or later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": [
        "Released under the MIT License", "Licensed under the MIT license", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "PublicDomain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal", "This is free and unencumbered software released into the public domain",
        "Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense"],
}
# fixed values: notices of one wording for several licences and versions
GNU = "it under the terms of the {} as published by the Free Software Foundation, either version {} of the License"
GNU_NAMES = [
    ("AGPL", "GNU Affero General Public License", ["3"]), ("GPL", "GNU General Public License", ["2", "3"]),
    ("LGPL", "GNU Lesser General Public License", ["2.1", "3"]), ("LGPL", "GNU Library General Public License", ["2"])]
CC = "This work is licensed under a Creative Commons {} {} License"
CC_NAMES = [
    ("CC-BY", "Attribution"), ("CC-BY-NC", "Attribution-NonCommercial"), ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivs"), ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("CC-BY-ND", "Attribution-NoDerivatives"), ("CC-BY-ND", "Attribution-NoDerivs"), ("CC-BY-SA", "Attribution-ShareAlike")]
CC_VERSIONS = ["4.0 International", "3.0 Unported"]
for _family, _name, _versions in GNU_NAMES:
    NOTICES[_family] += [GNU.format(_name, version) for version in _versions]
for _family, _name in CC_NAMES:
    NOTICES[_family] += [CC.format(_name, version) for version in CC_VERSIONS]
# fixed values: words of which a notice of the family has one
NEEDED = {
    "AGPL": {b"affero", b"agpl"}, "LGPL": {b"lesser", b"library", b"lgpl"}, "CC-BY-NC": {b"noncommercial", b"nc"},
    "CC-BY-NC-ND": {b"noderivatives", b"noderivs", b"nd"}, "CC-BY-NC-SA": {b"sharealike", b"sa"},
    "CC-BY-ND": {b"noderivatives", b"noderivs", b"nd"}, "CC-BY-SA": {b"sharealike", b"sa"}}
NEAR_MISSES = [
    "Her driving license was renewed in the spring", "The bar lost its liquor license last year", "He is a licensed physician in two states",
    "She studied at MIT before she moved to the public sector", "The Apache helicopter landed near the general store",
    "All rights reserved by the publisher", "The public library is in the domain of the city", "Released under pressure from the general public",
    "The commons voted on version 3 of the creative bill", "This file is part of the annual report and its conditions are met",
    "Copyright law protects the work of authors", "Permission to build was granted free of charge by the town",
    "The gnu is a large antelope that lives in the free plains", "A license fee is due for every television",
]
FAMILIES = sorted(NOTICES)
UNKNOWN = len(FAMILIES)

WINDOW, STEP = 40, 20
FEATURES = 1 << 16
VARIANTS = 24  # training variants of each notice
SAMPLE_DOCUMENTS, SAMPLE_LINES = 2_000, 6_000
SAMPLE_CHARS = 50_000
EPOCHS, BATCH, RATE = 12, 64, 0.5
CERTAIN = 0.5  # least calibrated probability of all families together
POSSIBLE = 0.02  # least calibrated probability of a family that a template may confirm
CONFIRMED = 0.6  # least share of a notice's word triples in a window
GROUP = 4_096  # windows scored at once
KNOWN_WORDS = 500_000


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def units(n: int) -> list[tuple[int, int]]:
    """Windows over a line of n words."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = [*range(0, n - WINDOW, STEP), n - WINDOW]
    return [(a, a + WINDOW) for a in starts]


def feature_rows(words: list[list[bytes]], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every word and every word pair of all windows, and where those of a window start."""
    sizes = np.array([len(one) for one in words])
    flat = np.fromiter((value for one in words for value in map(ids.__getitem__, one)), np.uint64, int(sizes.sum()))
    following = np.append(flat[1:], np.uint64(0))
    pairs = (flat * np.uint64(0x9E3779B97F4A7C15) + following * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    ends = np.cumsum(sizes) - 1
    rows = np.stack([flat & np.uint64(FEATURES - 1), pairs], 1).astype(np.int64)
    rows[ends, 1] = FEATURES  # a window's last word has no pair; this row stays zero
    return rows.ravel(), np.append(0, np.cumsum(2 * sizes))


class Classifier:
    def __init__(self):
        self.weights = np.zeros((FEATURES + 1, UNKNOWN + 1), np.float32)
        self.bias = np.zeros(UNKNOWN + 1, np.float32)
        self.sharpness = 1.0

    def logits(self, rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[rows], edges[:-1], axis=0) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        scaled = logits * self.sharpness
        p = np.exp(scaled - scaled.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _examples(lines: list[list[bytes]]) -> tuple[list[list[bytes]], list[int]]:
    """Windows and their families, for training and calibration."""
    draw = random.Random(9)
    other = [one for one in lines if not confirmed(one)]
    filler = other or [words_of(text) for text in NEAR_MISSES]
    words, kinds = [], []
    for number, family in enumerate(FAMILIES):
        for notice in NOTICES[family]:
            said = words_of(notice)
            for variant in range(VARIANTS):
                own = list(said)
                if variant % 3 == 1 and len(own) > 6:
                    del own[draw.randrange(len(own))]
                around = draw.choice(filler)
                cut = draw.randint(0, len(around))
                own = around[max(0, cut - draw.randint(0, 12)):cut] + own + around[cut:cut + draw.randint(0, 12)] if variant % 2 else own
                words.append(own[:WINDOW])
                kinds.append(number)
    for one in [*other, *[words_of(text) for text in NEAR_MISSES] * 8]:
        words += [one[a:b] for a, b in units(len(one))[:2]]
        kinds += [UNKNOWN] * min(2, len(units(len(one))))
    return words, kinds


def train(lines: list[list[bytes]]) -> Classifier:
    """A classifier of notices against the given lines (lists of words)."""
    words, kinds = _examples(lines)
    model, draw = Classifier(), np.random.default_rng(8)
    kinds = np.array(kinds)
    aside = np.arange(len(kinds)) % 7 == 3
    ids = WordIds()
    every = [feature_rows([one], ids)[0] for one in words]
    squares, bias_squares = np.full_like(model.weights, 1e-2), np.full_like(model.bias, 1e-2)
    fit = np.flatnonzero(~aside)
    for _ in range(EPOCHS):
        draw.shuffle(fit)
        for low in range(0, len(fit), BATCH):
            part = fit[low:low + BATCH]
            rows = np.concatenate([every[i] for i in part])
            sizes = np.array([len(every[i]) for i in part])
            p = model.probabilities(model.logits(rows, np.append(0, np.cumsum(sizes))))
            p[np.arange(len(part)), kinds[part]] -= 1
            known, where = np.unique(rows, return_inverse=True)
            gradient = np.zeros((len(known), UNKNOWN + 1), np.float32)
            np.add.at(gradient, where, np.repeat(p, sizes, axis=0) / len(part))
            gradient += 1e-5 * model.weights[known]
            squares[known] += gradient * gradient
            model.weights[known] -= RATE * gradient / np.sqrt(squares[known])
            model.weights[FEATURES] = 0
            bias_squares += p.mean(0) ** 2
            model.bias -= RATE * p.mean(0) / np.sqrt(bias_squares)
    kept = np.flatnonzero(aside)
    rows = np.concatenate([every[i] for i in kept])
    logits = model.logits(rows, np.append(0, np.cumsum([len(every[i]) for i in kept])))
    best, model_loss = 1.0, None
    for sharpness in np.geomspace(0.2, 5, 40):
        model.sharpness = float(sharpness)
        loss = -np.log(model.probabilities(logits)[np.arange(len(kept)), kinds[kept]] + 1e-9).mean()
        if model_loss is None or loss < model_loss:
            best, model_loss = model.sharpness, loss
    model.sharpness = best
    return model


def _triples(words: list[bytes]) -> set[tuple]:
    return set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)}


TEMPLATES = [(family, _triples(words_of(notice))) for family in FAMILIES for notice in NOTICES[family]]
HOLDERS: dict[tuple, list[int]] = {}
for _number, (_, _own) in enumerate(TEMPLATES):
    for _triple in _own:
        HOLDERS.setdefault(_triple, []).append(_number)


def confirmed(words: list[bytes]) -> list[tuple[str, int, list[int]]]:
    """(family, notice, places of its triples) of the notices that a window holds most of.

    A notice counts if it explains more triples than any of another family where it stands.
    """
    places = list(zip(words, words[1:], words[2:]))
    held: dict[int, list[int]] = {}
    for i, triple in enumerate(places):
        for number in HOLDERS.get(triple, ()):
            held.setdefault(number, []).append(i)
    good = []
    for number, at in sorted(held.items()):
        explained = len({places[i] for i in at})
        if explained >= CONFIRMED * len(TEMPLATES[number][1]):
            good.append((TEMPLATES[number][0], number, at, explained))
    out = []
    for family, number, at, explained in good:
        needed = NEEDED.get(family)
        if needed and needed.isdisjoint(words[at[0]:at[-1] + 3]):
            continue
        if all(more < explained for other, _, there, more in good
               if other != family and there[0] < at[-1] + 3 and at[0] < there[-1] + 3):
            out.append((family, number, at))
    return out


def crossing(words: list[bytes], lines: list[int]) -> list[tuple[str, int, int, int]]:
    """(family, notice, first line, last line) of the notices that a window holds and no single line of it does."""
    places = list(zip(words, words[1:], words[2:]))
    out = []
    for family, number, at in confirmed(words):
        alone = {}
        for i in at:
            if lines[i] == lines[i + 2]:
                alone.setdefault(lines[i], set()).add(places[i])
        if all(len(own) < CONFIRMED * len(TEMPLATES[number][1]) for own in alone.values()):
            out.append((family, number, lines[at[0]], lines[at[-1] + 2]))
    return out


def _joined(spans: set[tuple[int, int, str, int]]) -> set[tuple[int, int, str]]:
    """Spans of one notice that overlap, from neighbouring windows, as one."""
    out, last = set(), None
    for family, notice, start, end in sorted((f, n, a, b) for a, b, f, n in spans):
        if last and last[:2] == (family, notice) and start < last[3]:
            last = (family, notice, last[2], max(last[3], end))
        else:
            out |= {(last[2], last[3], last[0])} if last else set()
            last = (family, notice, start, end)
    return out | ({(last[2], last[3], last[0])} if last else set())


def scan(texts: list[str], model: Classifier, ids: WordIds) -> list[tuple[int, list[tuple[int, int, str, bool]]]]:
    """Per text the number of paragraphs and (start, end, family, confirmed) of those with a notice."""
    out = [[0, []] for _ in texts]
    wrapped = [set() for _ in texts]
    group, where = [], []

    def flush():
        if not group:
            return
        p = model.probabilities(model.logits(*feature_rows(group, ids)))
        for i in np.flatnonzero(p[:, :UNKNOWN].sum(1) >= CERTAIN):
            possible = {FAMILIES[f] for f in np.flatnonzero(p[i, :UNKNOWN] >= POSSIBLE)}
            owner, start, end, lines = where[i]
            if lines is None:
                sure = {family for family, _, _ in confirmed(group[i])} & possible
                out[owner][1].extend((start, end, family, True) for family in sure)
                if not sure:
                    out[owner][1].append((start, end, FAMILIES[int(p[i, :UNKNOWN].argmax())], False))
            else:
                for family, notice, first, last in crossing(group[i], lines):
                    if family in possible:
                        wrapped[owner].add((start[first], end[last], family, notice))
        group.clear()
        where.clear()

    def put(words, place):
        group.append(words)
        where.append(place)
        if len(group) >= GROUP:
            flush()

    def across(owner, block):
        """Windows over the lines of a block, as far as they hold more than one."""
        if len(block) > 1:
            words = [word for said, _, _ in block for word in said]
            lines = [i for i, (said, _, _) in enumerate(block) for _ in said]
            starts, ends = [a for _, a, _ in block], [b for _, _, b in block]
            for a, b in units(len(words)):
                if lines[a] != lines[b - 1]:
                    put(words[a:b], (owner, starts, ends, lines[a:b]))

    for owner, text in enumerate(texts):
        start, block = 0, []
        for line in text.split("\n"):
            words = words_of(line)
            if words:
                out[owner][0] += 1
                for a, b in units(len(words)):
                    put(words[a:b], (owner, start, start + len(line), None))
                block.append((words, start, start + len(line)))
            else:
                across(owner, block)
                block = []
            start += len(line) + 1
        across(owner, block)
    flush()
    for (_, found), spans in zip(out, wrapped):
        whole = _joined(spans)
        told = {(a, b) for a, b, _, sure in found if sure} | {(a, b) for a, b, _ in whole}
        found[:] = [one for one in found if one[3] or not any(a <= one[0] and one[1] <= b for a, b in told)]
        found += [(a, b, family, True) for a, b, family in whole]
    # windows of one line that say the same are one finding
    return [(n, sorted({(a, b, family): max(c for x, y, f, c in found if (x, y, f) == (a, b, family))
                        for a, b, family, _ in found}.items())) for n, found in out]


def fit(docs: DataFrame) -> Classifier:
    """A classifier whose other text are lines of at most SAMPLE_DOCUMENTS documents, picked by a hash."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(n, 1))
    picked = docs.select("text").filter(
        (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.char_length("text") <= SAMPLE_CHARS))
    texts = sorted(row["text"] for row in picked.distinct().collect() if row["text"])
    lines = sorted({line for text in texts for line in text.split("\n")}, key=lambda line: xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")))
    return train([words for line in lines[:SAMPLE_LINES] if (words := words_of(line))])


REPORT = ["doc_id", "n_paragraphs", "n_licences", "n_unconfirmed", "families", "spans"]


def report(docs: DataFrame) -> DataFrame:
    """Per document: paragraphs, those under a confirmed and an unconfirmed licence, families, and
    spans (family:start:end of the paragraph in code points) of the confirmed ones."""
    shared = by_value(docs.sparkSession, fit(docs))

    def run(batches):
        known, ids = opened(shared), WordIds()
        for batch in batches:
            rows = []
            texts = [text.as_py() or "" for text in batch.column("text")]
            for n, found in scan(texts, known, ids):
                good = [key for key, sure in found if sure]
                rows.append((n, len(good), len(found) - len(good), ",".join(sorted({family for _, _, family in good})),
                             ",".join(f"{family}:{a}:{b}" for a, b, family in good)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]], REPORT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        released(run), "doc_id long, n_paragraphs long, n_licences long, n_unconfirmed long, families string, spans string")
