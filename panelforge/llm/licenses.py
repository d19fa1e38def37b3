"""License scan: min-hash bands over overlapping text windows, then exact shingle containment.

Templates are short public license notices, a fixed library of bounded size. A text's words become
hashes, ``SHINGLE`` of them a shingle. For each template length a window of as many shingles slides
over the text in steps of an eighth of it; its min-hashes (sliding minima, found by doubling) are
grouped into ``BANDS`` bands of ``ROWS``. A window that shares a band with a template of its length
is a candidate. The window nearest to an occurrence is at most a sixteenth off; where
``CONTAINMENT`` of the template's shingles occur its Jaccard similarity s is at least 0.58, and it
is retrieved with probability 1 - (1 - s**ROWS)**BANDS, above 0.999; a whole notice (s >= 0.88)
above 1 - 1e-12. Candidates are verified on the words themselves, over the window widened by a step
on either side: no hash decides a match.

One pass, no shuffle. Texts are laid end to end and scanned in parts of about ``PART`` words; a
longer text is a part of its own.

Defined results: null, empty and blank texts have no match. Overlapping windows of one template are
one match, the best and first. Repeated rows are scanned one by one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SHINGLE = 3
CONTAINMENT = 0.8
BANDS, ROWS = 20, 2
#: Words scanned at once, about.
PART = 150_000

#: Public license notices: (name, notice).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited."),
)

_WORD = re.compile(r"\w+")
_SALT = [np.uint64(x) for x in np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.int64) | 1]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, map(str.encode, words)), dtype=np.uint64, count=len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    """A hash of every SHINGLE words in a row; empty for shorter texts."""
    n = len(h) - SHINGLE + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for j in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
            out ^= out >> np.uint64(29)
        return out


def _minima(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Minima of every 1, 2, 4, ... values in a row, up to ``most`` of them."""
    levels = [x]
    while (have := 1 << (len(levels) - 1)) * 2 <= most:
        levels.append(np.minimum(levels[-1][: len(levels[-1]) - have], levels[-1][have:]))
    return levels


def band_hashes(s: np.ndarray, shapes: list[tuple[int, int]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each band, its hash of every window, for each (size, step) in shapes."""
    most = max(size for size, _ in shapes)
    for b in range(BANDS):
        acc: list[np.ndarray] = []
        for r in range(ROWS):
            with np.errstate(over="ignore"):
                levels = _minima(((s * _SALT[b * ROWS + r]) >> np.uint64(32)).astype(np.uint32), most)
                for i, (size, step) in enumerate(shapes):
                    k = size.bit_length() - 1
                    n, off = len(s) - size + 1, size - (1 << k)
                    m = np.minimum(levels[k][:n:step], levels[k][off : off + n : step])
                    if r:
                        acc[i] = acc[i] * np.uint32(0x9E3779B1) ^ m
                    else:
                        acc.append(m)
        yield b, acc


class Library:
    def __init__(self, templates: tuple = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        self.words = [_WORD.findall(t.lower()) for _, t in templates]
        self.sets = [frozenset(zip(*[w[j:] for j in range(SHINGLE)], strict=False)) for w in self.words]
        sizes = sorted({len(w) - SHINGLE + 1 for w in self.words})
        self.shapes = [(n, max(1, n // 8)) for n in sizes]
        self.of = [[i for i, w in enumerate(self.words) if len(w) - SHINGLE + 1 == n] for n in sizes]
        self.keys: dict[tuple[int, int], int] = {}
        for (n, _), which in zip(self.shapes, self.of, strict=True):
            for i in which:
                for b, (h,) in band_hashes(shingles(word_hashes(self.words[i])), [(n, 1)]):
                    self.keys[b, i] = h[0]
        self.longest = max(sizes)

    def candidates(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(template, first shingle, size) of every window that shares a band with a template."""
        filler = np.random.default_rng(1).integers(0, 2**62, self.longest + SHINGLE).astype(np.uint64)
        s = shingles(np.concatenate([word_hashes(words), filler]))
        hit = [[None] * len(which) for which in self.of]
        for b, bands in band_hashes(s, self.shapes):
            for i, which in enumerate(self.of):
                for j, t in enumerate(which):
                    same = bands[i] == self.keys[b, t]
                    hit[i][j] = same if hit[i][j] is None else hit[i][j] | same
        return [(t, int(w) * step, size) for i, (size, step) in enumerate(self.shapes) for j, t in enumerate(self.of[i]) for w in np.flatnonzero(hit[i][j])]

    def scan(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, template, first word, words, containment), the best window of each run of overlaps."""
        starts = np.cumsum([0, *map(len, texts)])
        hits: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for t, w, size in self.candidates([x for t in texts for x in t]):
            step = max(1, size // 8)
            lo, hi = np.searchsorted(starts, [w, w + size - 1], side="right") - 1
            for d in range(lo, min(hi, len(texts) - 1) + 1):
                a, b = max(0, w - step - starts[d]), min(len(texts[d]), w + size + step - starts[d])
                if m := self.verify(texts[d], t, int(a), int(b)):
                    hits.setdefault((d, t), []).append(m)
        for (d, t), found in sorted(hits.items()):
            kept: list[tuple[int, int, float]] = []
            for m in sorted(found):
                if kept and m[0] < kept[-1][0] + kept[-1][1]:
                    if m[2] > kept[-1][2]:
                        kept[-1] = m
                else:
                    kept.append(m)
            for m in kept:
                yield d, t, *m

    def verify(self, words: list[str], t: int, a: int, b: int) -> tuple[int, int, float] | None:
        """Exact containment of the template's shingles among those that begin in words[a:b]."""
        want, at = self.sets[t], {}
        for i in range(a, b):
            g = tuple(words[i : i + SHINGLE])
            if g in want:
                at.setdefault(g, i)
        c = len(at) / len(want)
        if c < CONTAINMENT:
            return None
        first, last = min(at.values()), max(at.values())
        return first, last - first + SHINGLE, c


def find(texts: list[str], lib: Library) -> Iterator[tuple[int, int, int, int, float, int, int]]:
    """Matches with their places: text, template, first word, words, containment, start, end."""
    low = [t.lower() for t in texts]
    part: list[int] = []
    words: list[list[str]] = []
    held = 0
    for i, t in enumerate(low):
        part.append(i)
        words.append(_WORD.findall(t))
        held += len(words[-1])
        if held >= PART or i == len(low) - 1:
            for d, k, a, n, c in lib.scan(words) if held else ():
                spans = [m.span() for m in _WORD.finditer(low[part[d]])]
                yield part[d], k, a, n, c, spans[a][0], spans[a + n - 1][1]
            part, words, held = [], [], 0


MATCHES = "doc_id long, template int, license string, first_word long, n_words long, containment double, start long, end long"


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per match; start and end are characters of the lower-cased text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = Library(templates)
        for b in batches:
            rows = []
            ids = b.column(0).to_pylist()
            for m in find([t or "" for t in b.column(1).to_pylist()], lib):
                rows.append((ids[m[0]], m[1], lib.names[m[1]], *m[2:]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "template", "license", "first_word", "n_words", "containment", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, MATCHES)
