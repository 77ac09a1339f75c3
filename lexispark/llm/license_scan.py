"""License scans by conditional compression.

Candidate blocks are the words around each cue of licensing, as many on either side as the longest template has and a few more, whatever the line breaks;
blocks that touch are one. Each block is compressed once plainly and once with each template as a raw zstandard dictionary; the reductions rank the templates.
All that save anything are then confirmed by their exact wording, in this order: from the longest common run of words the template is laid over the block, its words are aligned with those there, and it
holds if all of its telling words (names and versions) are there in order, no other telling word stands between, and at most a tenth of its words differ.
The wording with the fewest differences wins, then the longest, then the one that saves most; the differences are reported.

A block can hold several notices: after a winner the words on either side of it are ranked again. Nulls: a null or empty text has no block; a null doc_id is allowed.
Rows that repeat are reported as often as they occur. Texts and lines of any length are searched whole; templates that tie go by their place in the list. An empty table gives an
empty result. Other columns, of any name, are not read. Only documents with findings have rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, utf8

# Wordings of public license notices, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
IDS = tuple(dict.fromkeys(spdx for spdx, _ in TEMPLATES))
TAG = re.compile(rb"(?i)SPDX-License-Identifier:[\x20\t]*(" + "|".join(sorted(map(re.escape, IDS), key=len, reverse=True)).encode() + rb")(?:-only|-or-later)?(?![\w.-]*\w)")
TELLING = frozenset("mit apache gnu general lesser affero library bsd isc mozilla cc by-nc by-sa by-nd by-nc-sa by-nc-nd cc0 1.0 1.1 2.0 2.1 2.5 3.0 4.0 2 3 3-clause 2-clause 4-clause gpl public".split())
CUE = r"(?i)licen[sc]e|copyright|spdx|permission is hereby|permission to use|redistribution and use|public domain|free software"
LOOSE = 0.1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Cues with any white space between their words.
CUES = re.compile(CUE.replace(" ", r"\s+").encode())


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip("\"'(),.;:!?").lower()


@lru_cache(maxsize=1)
def models() -> list[tuple[str, list[str], zstandard.ZstdCompressor]]:
    out = []
    for spdx, text in TEMPLATES:
        d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((spdx, [p for p in map(plain, text.encode().split()) if p], zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False)))
    return out


def blocks(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of candidate blocks, at word ends; all that a notice with some cue can take up lies within one of them."""
    cues = [m.span() for m in CUES.finditer(text)]
    if not cues:
        return []
    around = max(len(t) for _, t, _ in models())
    around += slack(around)
    words = [w.span() for w in WORD.finditer(text)]
    starts = [a for a, _ in words]
    out: list[list[int]] = []
    for a, b in cues:
        lo, hi = max(0, bisect_right(starts, a) - 1 - around), min(len(words), bisect_right(starts, b - 1) + around)
        if out and lo <= out[-1][1] and hi - out[-1][0] <= 4 * around:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(words[lo][0], words[hi - 1][1]) for lo, hi in out]


def slack(n: int) -> int:
    """How many words of n may differ."""
    return max(1, int(LOOSE * n))


def wording(template: list[str], words: list[str]) -> tuple[int, int, list[str]] | None:
    """Where in words the template stands (first, behind the last) and how they differ there; None if it does not hold."""
    telling = set(template) & TELLING
    if not telling <= set(words):
        return None
    # every place where a common run may put the template, the longest run first
    whole = SequenceMatcher(None, template, words, autojunk=False)
    runs = sorted((b for b in whole.get_matching_blocks() if b.size), key=lambda b: -b.size)
    for run in runs:
        lo = max(0, run.b - run.a - slack(len(template)))
        near = words[lo : run.b - run.a + len(template) + slack(len(template))]
        m = [b for b in SequenceMatcher(None, template, near, autojunk=False).get_matching_blocks() if b.size]
        got = {i for b in m for i in range(b.a, b.a + b.size)}
        missing = [template[i] for i in range(len(template)) if i not in got]
        if not m or len(missing) > LOOSE * len(template) or TELLING & set(missing):
            continue
        first, last = m[0].b, m[-1].b + m[-1].size
        held = {j for b in m for j in range(b.b, b.b + b.size)}
        extra = [near[j] for j in range(first, last) if j not in held]
        if len(extra) <= LOOSE * len(template) and not TELLING & set(extra):
            return lo + first, lo + last, [f"-{w}" for w in missing] + [f"+{w}" for w in extra]
    return None


def scan_block(block: bytes) -> list[tuple[str, int, int, int, list[str]]]:
    """(SPDX id, start byte, end byte, bytes saved, differences) of each notice in a block."""
    found = []
    parts = [(0, len(block))]
    while parts:
        a, b = parts.pop()
        words = [(m.start() + a, m.end() + a, plain(m[0])) for m in WORD.finditer(block[a:b])]
        words = [w for w in words if w[2]]
        if len(words) < 3:
            continue
        alone = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(block[a:b]))
        saved = sorted(((alone - len(z.compress(block[a:b])), -k) for k, (_, _, z) in enumerate(models())), reverse=True)
        confirmed = []
        for gain, k in saved:
            spdx, template, _ = models()[-k]
            if gain > 0 and (at := wording(template, [w[2] for w in words])):
                confirmed.append((-len(at[2]), len(template), gain, k, spdx, at))
        if confirmed:
            _, _, gain, _, spdx, (first, last, differ) = max(confirmed, key=lambda c: c[:4])
            found.append((spdx, words[first][0], words[last - 1][1], gain, differ))
            parts += [(a, words[first][0]), (words[last - 1][1], b)]
    return sorted(found, key=lambda x: x[1])


def notices(text: bytes) -> list[tuple[str, int, int, int, list[str]]]:
    """(SPDX id, start byte, end byte, bytes saved, differences) of each notice in a text; where blocks overlap the better of two that touch."""
    # tags name their license in so many words; there is nothing to rank
    ids = {i.lower(): i for i in IDS}
    found = [(ids[m[1].decode().lower()], m.start(), m.end(), 0, []) for m in TAG.finditer(text)]
    for lo, hi in blocks(text):
        found += [(spdx, lo + a, lo + b, gain, differ) for spdx, a, b, gain, differ in scan_block(text[lo:hi])]
    kept: list[tuple[str, int, int, int, list[str]]] = []
    at: list[int] = []
    for x in sorted(found, key=lambda x: (len(x[4]), x[1] - x[2], x[1])):
        k = bisect_right(at, x[1])
        if (not k or kept[k - 1][2] <= x[1]) and (k == len(kept) or x[2] <= kept[k][1]):
            kept.insert(k, x)
            at.insert(k, x[1])
    return kept


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, license, start_byte, end_byte, saved_bytes, differences), one row for each notice."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for k, text in enumerate(b.column("body").to_pylist()):
            for spdx, s, e, gain, differ in notices(text):
                at.append(k)
                rows.append((spdx, s, e, gain, " ".join(differ)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "license", "start_byte", "end_byte", "saved_bytes", "differences"])

    cued = docs.where(F.col("text").rlike(CUE.replace(" ", r"\\s+"))).select("doc_id", utf8("text").alias("body"))
    return map_arrow(cued, f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, start_byte long, end_byte long, saved_bytes long, differences string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
