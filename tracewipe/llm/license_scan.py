"""License scan by conditional compression.

A block that says little beyond a license template compresses to much less when the template is the
compressor's raw dictionary. Blocks slide over all words of the whole text, whatever its lines and
paragraphs. A wording is accepted if at most ``MISSING`` of its words are missing, so of any of its
words, one more than may be missing, one at least is there: the wording is laid over the text at every
place of its words that are rarest in that very text, as many as this needs, and no acceptable place is
left out. Where the surroundings hold enough of its words the block's relative size reduction under the
template is measured with zstandard. Places are ranked by it and confirmed word by word; the reduction
decides nothing else. A wording is there if no more than its share of words is missing, and none
that carries a digit (versions decide licenses).

The scan is one map over the documents after a filter on parts of words that every acceptable wording
has: nothing is shuffled. A text is scanned in parts of ``PART`` characters that overlap by more than
the longest block, so memory does not grow with a factor of the longest text.

Defined results: null and empty texts have no findings; a document without a finding has no row;
repeated rows give their findings again; null ids stay null; letter case, punctuation and line breaks
inside a wording do not matter, nor how long the line is or where in it the wording stands; between its
words up to as many others may stand as it has. Of findings that share words the one with the larger
gain stays, on a tie the one with fewer words missing, then the smaller name, then the earlier. An
empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = 0.1
PART = 1 << 20

# Wordings in common use, by SPDX name where there is one.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

#: SPDX tags: the names above, and how they go on for licenses that may be taken in a later version.
TAGGED = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense")
for _name in TAGGED:
    _ends = ("", "-only", "-or-later") if "GPL" in _name else ("",)
    TEMPLATES[_name] = (*TEMPLATES.get(_name, ()), *(f"SPDX-License-Identifier: {_name}{end}" for end in _ends))

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Template:
    def __init__(self, name: str, wording: str):
        self.name, self.words = name, words(wording)
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)
        self.allowed = int(MISSING * len(self.words))
        d = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


@lru_cache(maxsize=1)
def _templates() -> list[_Template]:
    return [_Template(name, wording) for name, wordings in TEMPLATES.items() for wording in wordings]


@lru_cache(maxsize=1)
def _plain():
    return zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)


@lru_cache(maxsize=1)
def gates() -> tuple[str, ...]:
    """Parts of words, one of which is in every text with an acceptable wording.

    Each template has more different words with such a part than may be missing: its longest words are
    added until it has.
    """
    out = ["licens"]
    for t in _templates():
        rest = sorted((w for w in t.places if not any(g in w for g in out)), key=lambda w: (-len(w), w))
        while sum(any(g in w for g in out) for w in t.places) <= t.allowed:
            out.append(rest.pop(0))
    return tuple(out)


def gain(block: list[str], template: _Template) -> float:
    """Relative size reduction of the block under the template."""
    raw = " ".join(block).encode()
    alone = len(_plain().compress(raw))
    return (alone - len(template.compressor.compress(raw))) / alone


def differences(block: list[str], wording: list[str]) -> tuple[list[str], int, int]:
    """Words of ``wording`` that the block lacks in order, start and end of what is used."""
    spans = [m for m in SequenceMatcher(None, wording, block, autojunk=False).get_matching_blocks() if m.size]
    held = {i for a, _, n in spans for i in range(a, a + n)}
    return [w for i, w in enumerate(wording) if i not in held], spans[0].b if spans else 0, spans[-1].b + spans[-1].size if spans else 0


FINDING = "doc_id long, license string, first_line long, last_line long, words_missing long, missing array<string>, gain double"


def _placed(block: list[str], template: _Template, at: dict[str, list[int]]) -> Iterator[tuple[float, int]]:
    """(gain, place of the first word) wherever an acceptable wording can lie."""
    size = len(template.words)
    there = sorted((w for w in template.places if w in at), key=lambda w: (len(at[w]), w))
    spare = template.allowed - (len(template.places) - len(there))
    if spare < 0:
        return
    places = {max(0, h - k) for w in there[: spare + 1] for h in at[w] for k in template.places[w]}
    for place in sorted(places):
        lo, hi = max(0, place - size), place + 2 * size
        if len(template.places.keys() - set(block[lo:hi])) > template.allowed:
            continue
        yield max(gain(block[place : place + size], template), gain(block[place:hi], template), gain(block[lo : place + size], template)), place


def _in_block(block: list[str]) -> Iterator[tuple[float, str, int, int, tuple[str, ...]]]:
    """(gain, license, first word, end, words missing) of every confirmed wording; they may share words."""
    known = _vocabulary()
    at: dict[str, list[int]] = {}
    for i, w in enumerate(block):
        if w in known:
            at.setdefault(w, []).append(i)
    for t in _templates():
        size = len(t.words)
        for best, place in _placed(block, t, at):
            # as the wording lies, then with words between its own
            for lo, hi in ((place, place + size), (max(0, place - size), place + 2 * size)):
                lacking, first, end = differences(block[lo:hi], t.words)
                if len(lacking) <= t.allowed and not any(any(c.isdigit() for c in w) for w in lacking):
                    yield best, t.name, lo + first, lo + end, tuple(lacking)
                    break


@lru_cache(maxsize=1)
def _vocabulary() -> frozenset[str]:
    return frozenset(w for t in _templates() for w in t.words)


def _parts(text: str) -> Iterator[tuple[int, list[str], list[int]]]:
    """(number of the first word, words, their lines from 1): all of the text in overlapping parts."""
    overlap = 4 * max(len(t.words) for t in _templates())
    first, block, lines, at, line = 0, [], [], 0, 1
    while at < len(text):
        stop = at + PART
        if stop < len(text):
            cut = re.compile(r"[^A-Za-z0-9.-]").search(text, stop)
            stop = cut.end() if cut else len(text)
        for k, part in enumerate(text[at:stop].split("\n")):
            line += k > 0
            found = words(part)
            block += found
            lines += [line] * len(found)
        at = stop
        yield first, block, lines
        gone = max(0, len(block) - overlap)
        first, block, lines = first + gone, block[gone:], lines[gone:]


def findings(text: str) -> list[tuple[str, int, int, int, list[str], float]]:
    """(license, first line, last line, words missing, these words, gain), lines from 1."""
    found = set()
    for first, block, lines in _parts(text):
        for best, name, lo, hi, lacking in _in_block(block):
            found.add((-best, len(lacking), name, first + lo, first + hi, lines[lo], lines[hi - 1], lacking))
    taken: set[int] = set()
    out = []
    for best, n, name, lo, hi, line, last, lacking in sorted(found):
        if taken.isdisjoint(range(lo, hi)):
            taken.update(range(lo, hi))
            out.append((lo, (name, line, last, n, list(lacking), -best)))
    return [f for _, f in sorted(out)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64()]
    names = [c.split()[0] for c in FINDING.split(", ")]
    for b in batches:
        rows = [(doc, *f) for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for f in findings(text.as_py())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per license wording found in a document."""
    able = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").rlike("(?i)" + "|".join(re.escape(g) for g in gates())))
    return able.mapInArrow(_scan, FINDING)


def _oracle() -> str:
    """Every wording looked for word by word at every place of every text; of two that share their start the longer one."""
    known = ", ".join("(" + ", ".join([repr(t.name), str(len(t.words)), repr(" ".join(t.words))]) + ")" for t in _templates())
    return rf"""
WITH known(license, size, wording) AS (VALUES {known}),
lines AS (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
split AS (SELECT doc_id, rid, no, regexp_extract_all(lower(line), '[a-z0-9]+(?:[.-][a-z0-9]+)*') AS ws FROM lines),
texts AS (SELECT doc_id, rid, flatten(list(ws ORDER BY no)) AS ws, flatten(list(list_transform(ws, lambda w: no) ORDER BY no)) AS nos FROM split GROUP BY doc_id, rid),
able AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS joined FROM texts WHERE len(ws) > 0),
hits AS (SELECT doc_id, rid, license, size, nos, unnest(list_filter(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' ') = wording)) AS place
         FROM able JOIN known ON contains(joined, ' ' || wording || ' '))
SELECT doc_id, license, CAST(nos[place] AS BIGINT) AS first_line, CAST(0 AS BIGINT) AS words_missing
FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits l WHERE l.rid = h.rid AND l.place = h.place AND l.size > h.size)
"""


ORACLE = _oracle()
